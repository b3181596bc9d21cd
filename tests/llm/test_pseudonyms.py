import datetime
import re

import pytest

from zonewise.llm import pseudonyms
from zonewise.llm.pseudonyms import Pseudonyms

KEY = b"test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations(size):
    images = [pseudonyms.permute(i, size, KEY, "a") for i in range(size)]
    assert sorted(images) == list(range(size))
    assert [pseudonyms.restore(x, size, KEY, "a") for x in images] == list(range(size))
    if size == 1000:
        assert images != [pseudonyms.permute(i, size, b"other", "a") for i in range(size)]


def luhn(number):
    digits = re.sub(r"\D", "", number)
    return int(digits[-1]) == pseudonyms.luhn_digit(digits[:-1])


VALUES = {
    "email": ["und.34@mail7.example.com", "a@b.co"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "4845168114407329"],
    "ip": ["233.254.104.120", "10.0.0.1"],
    "phone": ["+1 (017) 555-7713", "212-555-1234", "+49 30 1234567"],
    "date": ["2024-02-29", "31.12.1999", "12/31/1999"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
}


def test_values_are_exchanged_within_their_format_and_back():
    forward, back = Pseudonyms(KEY), Pseudonyms(KEY, undo=True)
    for kind, values in VALUES.items():
        for value in values:
            text = f"see {value} here, and {value}!!"
            new, found = forward(text)
            one, two = re.fullmatch(r"see (.*) here, and (.*)!!", new).groups()
            assert found == {kind: 2} and one == two != value, (kind, value, new)
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", one))) == re.sub(
                r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value))
            ) or kind == "ip"
            assert back(new)[0] == text
            if kind == "card":
                assert luhn(one)
            if kind == "ip":
                assert max(map(int, one.split("."))) <= 255
            if kind == "date" and "-" in one:
                datetime.date.fromisoformat(one)
    new, found = forward('token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!')
    assert found == {"secret": 1} and re.fullmatch(r'token = "[0-9A-F]{40}"!!', new) and "9233A8" not in new
    assert back(new)[0] == 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'


@pytest.mark.parametrize("text", [
    "", "plain words.", "9807915762804491", "4111111111111112", "300.1.1.1", "1.2.3.4.5", "2024-02-30", "v4.0. 3.",
    "DE89 3704 0044 0532 0130 01", "id 12345", "10 000 000",
])
def test_other_texts_stay(text):
    assert Pseudonyms(KEY)(text) == (text, {})


def test_documents(docs):
    given = docs([(1, None), (2, ""), (3, "4111111111111111"), (4, "x 4111111111111111"), (None, "words " * 50_000)])
    out = pseudonyms.pseudonymise(given, KEY)
    assert out.columns == given.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[4] == "x " + text[3] and text[None] == "words " * 50_000
    counted = pseudonyms.pseudonymise(given, KEY, counts=True)
    assert counted.columns.count("n_card") == 1 and {r.doc_id: r.n_card for r in counted.collect()}[3] == 1
    assert pseudonyms.pseudonymise(docs([]), KEY).collect() == []


def test_dates_with_the_day_first_and_with_one_digit():
    there, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", undo=True)
    shapes = "25/12/2020 13/1/2020 5/3/2021 5/25/2021 25/5/2021 1.2.2020 31.1.1999 05/3/2021 2024-1-05 12/31/1999".split()
    for one in shapes:
        new, found = there(f"am {one}, so")
        assert found == {"date": 1} and new != f"am {one}, so"
        assert [len(p) for p in re.split(r"\D", new[3:-4])] == [len(p) for p in re.split(r"\D", one)]
        assert back(new)[0] == f"am {one}, so"
    days = [f"{d}/{m}/{y}" for y in (1900, 2020, 2099) for m in range(1, 13) for d in range(1, 29)]
    assert len({there(d)[0] for d in days}) == len(days)
    assert all(back(there(d)[0])[0] == d for d in days)
    for none in ("32/13/2020", "30/2/2020", "1.13.2020", "1.2.2020.4"):
        assert there(none)[1]["date"] == 0

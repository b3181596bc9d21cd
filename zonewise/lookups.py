"""Fixed tables: state codes, contaminant groups, measurement rounds, labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# FIPS code, postal code and name of the states and the capital district.
STATES = [
    ("01", "AL", "Alabama"), ("02", "AK", "Alaska"), ("04", "AZ", "Arizona"), ("05", "AR", "Arkansas"),
    ("06", "CA", "California"), ("08", "CO", "Colorado"), ("09", "CT", "Connecticut"), ("10", "DE", "Delaware"),
    ("11", "DC", "District of Columbia"), ("12", "FL", "Florida"), ("13", "GA", "Georgia"), ("15", "HI", "Hawaii"),
    ("16", "ID", "Idaho"), ("17", "IL", "Illinois"), ("18", "IN", "Indiana"), ("19", "IA", "Iowa"),
    ("20", "KS", "Kansas"), ("21", "KY", "Kentucky"), ("22", "LA", "Louisiana"), ("23", "ME", "Maine"),
    ("24", "MD", "Maryland"), ("25", "MA", "Massachusetts"), ("26", "MI", "Michigan"), ("27", "MN", "Minnesota"),
    ("28", "MS", "Mississippi"), ("29", "MO", "Missouri"), ("30", "MT", "Montana"), ("31", "NE", "Nebraska"),
    ("32", "NV", "Nevada"), ("33", "NH", "New Hampshire"), ("34", "NJ", "New Jersey"), ("35", "NM", "New Mexico"),
    ("36", "NY", "New York"), ("37", "NC", "North Carolina"), ("38", "ND", "North Dakota"), ("39", "OH", "Ohio"),
    ("40", "OK", "Oklahoma"), ("41", "OR", "Oregon"), ("42", "PA", "Pennsylvania"), ("44", "RI", "Rhode Island"),
    ("45", "SC", "South Carolina"), ("46", "SD", "South Dakota"), ("47", "TN", "Tennessee"), ("48", "TX", "Texas"),
    ("49", "UT", "Utah"), ("50", "VT", "Vermont"), ("51", "VA", "Virginia"), ("53", "WA", "Washington"),
    ("54", "WV", "West Virginia"), ("55", "WI", "Wisconsin"), ("56", "WY", "Wyoming"),
]

# Which group a contaminant is reported under.
CONTAMINANT_GROUPS = {
    "PFAS (Simplified)": [
        "pfoa35", "pfos35", "pfna35", "pfhxs35", "pfbs35", "pfhpa35", "pfba", "pfhxa", "pfpea", "fts62",
    ],
    "Metals": [
        "chromium", "chromium6", "cobalt", "molybdenum", "strontium", "vanadium", "lithium", "germanium",
        "manganese",
    ],
    "Disinfection Byproducts": ["chlorate", "haa5", "haa6br", "haa9"],
    "VOCs / Solvents": ["dichloroethane11", "dioxane14", "HCFC22", "Halon1011"],
    "Pesticides, Perchlorate, Other": ["dcpa", "perchlorate", "butanol1"],
}
UNGROUPED = "Uncategorized"

# The contaminants of each measurement round, by the stem of their column names.
ROUNDS = {
    "UCMR1": ["dcpa", "perchlorate"],
    "UCMR3": [
        "HCFC22", "Halon1011", "chlorate", "chromium", "chromium6", "cobalt", "dichloroethane11", "dioxane14",
        "molybdenum", "strontium", "vanadium", "pfasany_3", "pfbs_3", "pfhpa_3", "pfhxs_3", "pfna_3", "pfoa_3", "pfos_3",
        "pfospfoa_3",
    ],
    "UCMR4": ["butanol1", "germanium", "haa5", "haa6br", "haa9", "manganese"],
    "UCMR5": [
        "fts62", "lithium", "pfba", "pfhxa", "pfpea", "pfasany_5", "pfasany_5t", "pfbs_5", "pfhpa_5", "pfhxs_5", "pfna_5",
        "pfoa_5", "pfos_5", "pfospfoa_5",
    ],
    "UCMR3or5": ["pfbs_35", "pfhpa_35", "pfhxs_35", "pfna_35", "pfoa_35", "pfos_35"],
}
ROUND_OF = {stem: label for label, stems in ROUNDS.items() for stem in stems}
OTHER_ROUND = "Other"

# Final column names. Chemicals of the PFAS group measured in round 5 alone get "_5"; the first "pws" becomes "cws".
ROUND_5_ONLY = [stem for stem in ROUNDS["UCMR5"] if stem in CONTAMINANT_GROUPS["PFAS (Simplified)"]]
FINAL_RENAMES = [(f"({'|'.join(ROUND_5_ONLY)})", r"\1_5"), ("pws", "cws")]

# Size classes of systems by people served.
POPULATION_CLASSES = {
    1: "≤500", 2: "501–3,300", 3: "3,301–10,000", 4: "10,001–100,000", 5: ">100,000",
}

# FIPS codes and agencies outside the contiguous states.
NON_CONTIGUOUS_FIPS = {"02": "AK", "15": "HI", "66": "GU", "72": "PR"}


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A small constant table, known to the planner by its true size."""

    def sql(value) -> str:
        if value is None:
            return "null"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(value)

    body = ", ".join("(" + ", ".join(map(sql, row)) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(columns)})")


def states(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["state_fips", "state_abbr", "state_name"], STATES)

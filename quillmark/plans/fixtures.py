"""Views over the test tables and the SQL text both engines' queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.ids import paper_key
from quillmark.operators.ordinal import last_per_key
from quillmark.session import read_table

#: A lexicon over the field's vocabulary: (order, category, keywords).
LEXICON = [
    (0, "Membrane traffic", ["cargo unloading", "endosome sorting", "vesicle budding"]),
    (1, "Cytoskeleton and polarity", ["actin bundling", "spindle assembly", "cortical tension"]),
    (2, "Signalling", ["signalling", "calcium uptake", "receptor"]),
    (3, "Adhesion and mechanics", ["focal adhesion", "junction remodelling", "collective migration"]),
    (4, "Cell division", ["centriole duplication", "cilium disassembly", "act"]),
    (5, "Genome upkeep", ["replication fork", "telomere capping", "histone exchange"]),
    (6, "Autophagy and cell death", ["autophagosome", "lysosomal", "proteasome"]),
    (7, "Metabolism and stress", ["glycogen storage", "lipid droplet", "stress granule"]),
    (8, "Stem cells and ageing", ["cell fate", "mitochondrial fission"]),
]

#: Screening rules of the test queries: thresholds and patterns of our own.
MIN_ABSTRACT, MIN_FULL_TEXT = 80, 500
EXCLUDED_TYPES = ["brief-report"]
TITLE_PATTERN = r"(?i)\b(review|erratum|correction|reply)\b"
WITHDRAWN_PATTERN = r"(?i)\b(retracted|retraction|withdrawn)\b"

PAPER_SQL = r"regexp_replace(upper(trim({c}, E' \t\n\r')), '^PMC', '')"


def paper_sql(c: str) -> str:
    return PAPER_SQL.format(c=c)


def ids_sql(c: str) -> str:
    """The distinct ids of a text as a list, in the order of their first appearance."""
    every = rf"list_filter(regexp_split_to_array(upper(coalesce({c}, '')), '[\s,]+'), lambda x: x <> '')"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


def plain_sql(c: str) -> str:
    """Typography normalised, as far as SQL can: compatibility forms are left out, which the texts do not have."""
    return rf"""trim(regexp_replace(translate({c}, '‘’“”‐‑‒–—', E'\'\'""-----'), '[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"""


def latest_papers(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every paper, by received_at and row_id."""
    p = read_table(spark, d, "paper").withColumn("paper", paper_key(F.col("pmcid"))).filter("paper is not null")
    return last_per_key(p, ["paper"], ["received_at", "row_id"])


LATEST_SQL = f"""latest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, {paper_sql('pmcid')} AS paper, row_number() OVER (PARTITION BY {paper_sql('pmcid')} ORDER BY received_at DESC, row_id DESC) AS rn FROM paper WHERE pmcid IS NOT NULL) WHERE rn = 1
)"""

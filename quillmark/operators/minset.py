"""Combinatorial operators: subsets, minimum sufficient subset, exact minimum cover, deletion tests (CO1-CO6).

Units are what references cover: FACT units, of which a paper's chosen facts make one each, and BRIDGE units, one for every
bridge and reference that supports it. Covers work on (paper, ref, unit) rows. Three reductions are relational and hold for
papers of any size: a reference that is the only one to cover some unit belongs to every cover, what these cover needs
nothing more, and of references that cover the same of what is left only the best can be in a minimum cover. What is left
of a paper then is solved exactly if it has at most MAX_UNITS units; a paper with more gets a row that says so and names
the references that every cover has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facts that a paper may have for its subsets to be assessed, and units that a cover is solved for after the reductions.
FACTS, MAX_UNITS = (2, 6), 10


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n)


def subset_masks(n: Column, least: int = 2) -> Column:
    """Array of the masks of all subsets of n units with at least `least` members, by size, then lexicographic order (CO1)."""
    masks = F.filter(F.sequence(F.lit(1), _bit(n) - 1), lambda m: F.bit_count(m) >= least)
    # lexicographic order of member lists is descending order of the bit-reversed mask
    keyed = F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("k"), (-F.conv(F.reverse(F.lpad(F.bin(m), 31, "0")), 2, 10).cast("bigint")).alias("r"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x.m)


def fact_counts(facts: DataFrame, paper: str = "paper", allowed: tuple[int, int] = FACTS) -> DataFrame:
    """(paper, n_facts, status): OK, or why the paper's subsets are not assessed: TOO_FEW_FACTS, TOO_MANY_FACTS."""
    n = F.col("n_facts")
    status = F.when(n < allowed[0], "TOO_FEW_FACTS").when(n > allowed[1], "TOO_MANY_FACTS").otherwise("OK")
    return facts.groupBy(paper).agg(F.count(F.lit(1)).alias("n_facts")).withColumn("status", status)


def paper_units(facts: DataFrame, paper: str = "paper", key: str = "fact_key", allowed: tuple[int, int] = FACTS) -> DataFrame:
    """(paper, fact_key, unit, n_units): the facts of papers that have an allowed number of them, numbered from 0 by key."""
    fit = fact_counts(facts, paper, allowed).filter("status = 'OK'").select(paper, F.col("n_facts").alias("n_units"))
    return facts.join(fit, paper).withColumn("unit", F.row_number().over(Window.partitionBy(paper).orderBy(key)) - 1)


def reference_masks(units: DataFrame, edges: DataFrame, paper: str = "paper", key: str = "fact_key", ref: str = "ref") -> DataFrame:
    """(paper, ref, mask): the facts each reference is near, as a mask (AG10)."""
    j = edges.join(units.select(paper, key, "unit"), [paper, key])
    return j.groupBy(paper, ref).agg(F.bit_or(_bit(F.col("unit"))).alias("mask"))


def coverage_units(facts: DataFrame, bridges: DataFrame | None = None, paper: str = "paper", fact: str = "fact_id", ref: str = "ref") -> DataFrame:
    """(paper, ref, unit): the distinct units each reference covers, FACT:id and BRIDGE:id:reference (JN12, CO6).

    facts: (paper, fact, ref). bridges: (paper, bridge_id, status, ref), of which those ESTABLISHED or PARTIAL count.
    """
    out = facts.select(paper, ref, F.concat(F.lit("FACT:"), F.col(fact).cast("string")).alias("unit"))
    if bridges is not None:
        kept = bridges.filter(F.col("status").isin("ESTABLISHED", "PARTIAL"))
        out = out.unionByName(kept.select(paper, ref, F.concat_ws(":", F.lit("BRIDGE"), F.col("bridge_id").cast("string"), ref).alias("unit")))
    return out.filter(F.col("unit").isNotNull() & F.col(ref).isNotNull()).distinct()


def confidences(covers: DataFrame, paper: str = "paper", ref: str = "ref") -> DataFrame:
    """(paper, ref, confidence): by default the number of units a reference covers."""
    return covers.groupBy(paper, ref).agg(F.count(F.lit(1)).cast("double").alias("confidence"))


def uncovered_units(required: DataFrame, covers: DataFrame, paper: str = "paper") -> DataFrame:
    """(paper, unit): required units that no reference covers (CO3)."""
    return required.select(paper, "unit").distinct().join(covers.select(paper, "unit"), [paper, "unit"], "left_anti")


def smallest_cover(masks: list[int], scores: list[float]) -> list[int]:
    """Positions of the exact minimum cover of all bits of the masks: fewest, then the greatest total score, then the one whose
    positions, compared from the last, are smallest.

    By layers: layer k maps each union that k masks can reach, and fewer cannot, to the best k of them. The first layer
    with the whole union has the answer.
    """
    goal = 0
    for m in masks:
        goal |= m
    layer: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    seen = {0}
    while goal not in layer:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for union, (score, picks) in layer.items():
            for i, m in enumerate(masks):
                more = union | m
                if more in seen:
                    continue
                rank = (score - scores[i], tuple(sorted((*picks, i), reverse=True)))  # scores are summed up as losses
                if more not in after or rank < after[more]:
                    after[more] = rank
        seen |= set(after)
        layer = after
    return sorted(layer[goal][1])


def minimum_cover(covers: DataFrame, scores: DataFrame | None = None, paper: str = "paper", ref: str = "ref", most: int = MAX_UNITS) -> tuple[DataFrame, DataFrame]:
    """Exact minimum covers of the units that any reference covers (CO3).

    covers: (paper, ref, unit), distinct; scores: (paper, ref, confidence). Returns the members (paper, ref, forced) and the
    papers (paper, n_units, n_left, status): status is EXACT, or OVER_LIMIT where more than `most` units are left after the
    reductions; the members of such a paper are only the references that every cover has.
    """
    scores = confidences(covers, paper, ref) if scores is None else scores
    lone = covers.groupBy(paper, "unit").agg(F.count(F.lit(1)).alias("_n"), F.min(ref).alias(ref)).filter("_n = 1")
    forced = lone.select(paper, ref).distinct()
    done = covers.join(forced, [paper, ref], "left_semi").select(paper, "unit").distinct()
    left = covers.join(done, [paper, "unit"], "left_anti")
    counts = covers.select(paper, "unit").distinct().groupBy(paper).agg(F.count(F.lit(1)).alias("n_units"))
    counts = counts.join(left.select(paper, "unit").distinct().groupBy(paper).agg(F.count(F.lit(1)).alias("n_left")), paper, "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))
    papers = counts.withColumn("status", F.when(F.col("n_left") <= most, "EXACT").otherwise("OVER_LIMIT"))
    small = papers.filter((F.col("n_left") > 0) & (F.col("status") == "EXACT")).select(paper)
    rest = left.join(small, paper, "left_semi")
    numbered = rest.select(paper, "unit").distinct().withColumn("_bit", F.row_number().over(Window.partitionBy(paper).orderBy("unit")) - 1)
    masks = rest.join(numbered, [paper, "unit"]).groupBy(paper, ref).agg(F.bit_or(_bit(F.col("_bit"))).alias("mask")).join(scores, [paper, ref])
    best = masks.groupBy(paper, "mask").agg(F.min_by(F.struct(ref, "confidence"), F.struct(-F.col("confidence"), ref)).alias("b")).select(paper, "mask", "b.*")
    packed = best.groupBy(paper).agg(F.array_sort(F.collect_list(F.struct(ref, "mask", "confidence"))).alias("options"))
    kind, ref_kind = covers.schema[paper].dataType.simpleString(), covers.schema[ref].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, options[i][ref]) for p, options in zip(pdf[paper], pdf["options"]) for i in smallest_cover([int(o["mask"]) for o in options], [float(o["confidence"]) for o in options])]
            yield pd.DataFrame(rows, columns=[paper, ref])

    chosen = packed.mapInPandas(run, f"`{paper}` {kind}, `{ref}` {ref_kind}")
    return forced.withColumn("forced", F.lit(True)).unionByName(chosen.withColumn("forced", F.lit(False))), papers


def removal_test(covers: DataFrame, paper: str = "paper", ref: str = "ref") -> DataFrame:
    """(paper, ref, newly_uncovered, indispensable): the units only this reference of a set covers (CO4). Linear, for papers of
    any number of units."""
    lone = covers.groupBy(paper, "unit").agg(F.count(F.lit(1)).alias("_n"), F.min(ref).alias(ref)).filter("_n = 1").groupBy(paper, ref).agg(F.count(F.lit(1)).alias("newly_uncovered"))
    out = covers.select(paper, ref).distinct().join(lone, [paper, ref], "left")
    return out.select(paper, ref, F.coalesce("newly_uncovered", F.lit(0)).alias("newly_uncovered"), F.col("newly_uncovered").isNotNull().alias("indispensable"))


def smallest_sufficient(subsets: DataFrame, paper: str = "paper", confidence: str = "confidence") -> DataFrame:
    """(paper, mask, fallback): the sufficient subset of fewest units, then greatest confidence, then first (CO2, SL5); the
    set of all units, marked as fallback, where none is sufficient."""
    order = F.struct(F.bit_count("mask"), -F.col(confidence), F.col("subset_no"))
    return subsets.groupBy(paper).agg(F.min_by("mask", F.when(F.col("sufficient"), order)).alias("m"), F.max_by("mask", F.bit_count("mask")).alias("whole")).select(
        paper, F.coalesce("m", "whole").alias("mask"), F.col("m").isNull().alias("fallback")
    )


def deletion_test(subsets: DataFrame, chosen: DataFrame, paper: str = "paper") -> DataFrame:
    """(paper, unit, indispensable): whether the chosen subset without a unit is no longer sufficient (CO5).

    A remaining set that was not assessed (of fewer than two units) makes the unit indispensable."""
    each = chosen.select(paper, "mask", F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda u: F.bit_count(F.col("mask").bitwiseAND(_bit(u))) > 0)).alias("unit"))
    each = each.withColumn("left_mask", F.col("mask").bitwiseAND(F.bitwise_not(_bit(F.col("unit")))))
    known = subsets.select(paper, F.col("mask").alias("left_mask"), "sufficient")
    return each.join(known, [paper, "left_mask"], "left").select(paper, "unit", (~F.coalesce("sufficient", F.lit(False))).alias("indispensable"))

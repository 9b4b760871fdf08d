"""Mixing sources to target weights.

The size of a source is its number of tokens. Capped water-filling shares the mix's total among its sources in
proportion to their targets; a source that would need more than max_repeats copies of its records is clamped
there, and what it can't give goes to the others in proportion, until nothing changes. A source at 2.3 repeats
gives every record twice and a seeded 30 % of its records once more.

Defined results
* the total of a mix is ``epochs`` times the tokens its sources hold (1 by default), or what the caps allow if
  that is less;
* a target source without records, or with only empty texts, gives nothing and its weight goes to the others;
* records with a null source, of no mix, or without tokens (null, empty) are left out;
* a null or negative target share counts as 0, a null max_repeats as 1; repeated target rows count once, and of rows
  that differ the greatest share and the greatest max_repeats hold;
* equal texts under several ids are records of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tokenizer import VOCABULARY, count_tokens
from docweave.session import cut_lineage

SEED = 17
#: Most rows a table of mix targets may have; it is held on the driver.
MAX_TARGETS = 10_000


def water_fill(shares: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """Amount of each source: in proportion to the shares, no more than the capacity, excess redistributed."""
    given = dict.fromkeys(shares, 0.0)
    free = {s for s in shares if shares[s] > 0 and capacity.get(s, 0) > 0}
    left = min(total, sum(capacity[s] for s in free))
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if left * shares[s] / weight >= capacity[s]}
        if not full:
            for s in free:
                given[s] = left * shares[s] / weight
            break
        for s in full:
            given[s] = capacity[s]
        left -= sum(capacity[s] for s in full)
        free -= full
    return given


def sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source and tokens of every record with a source and at least one token; written once, read often."""
    counted = count_tokens(documents.select("doc_id", "source", "text").where("source is not null and length(text) > 0"), path=path)
    return cut_lineage(counted.where("tokens > 0"))


def plan(sized: DataFrame, targets: DataFrame, epochs: float = 1.0) -> list[dict]:
    """One entry per mix and source: target share, tokens held, amount allotted, repeats. Bounded by the targets."""
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} mix targets")
    wanted = sorted({r.source for r in rows})
    held = {r.source: r.tokens for r in sized.where(F.col("source").isin(wanted)).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    out = []
    for mix in sorted({r.mix_name for r in rows}):
        own = sorted((r for r in rows if r.mix_name == mix), key=lambda r: r.source)
        shares = {r.source: max(r.target_share or 0.0, 0.0) for r in own}
        caps = {r.source: 1 if r.max_repeats is None else max(r.max_repeats, 0) for r in own}
        amount = water_fill(shares, {s: float(held.get(s, 0) * caps[s]) for s in shares}, epochs * sum(held.get(s, 0) for s in shares))
        for s in shares:
            repeats = min(amount[s] / held[s], caps[s]) if held.get(s) else 0.0
            out.append({"mix_name": mix, "source": s, "target_share": shares[s], "max_repeats": caps[s], "held_tokens": held.get(s, 0), "repeats": repeats})
    return out


def _plan_table(sized: DataFrame, entries: list[dict]) -> DataFrame:
    schema = "mix_name string, source string, target_share double, max_repeats int, held_tokens long, repeats double"
    return sized.sparkSession.createDataFrame([tuple(e.values()) for e in entries], schema)


def mix(sized: DataFrame, entries: list[dict], seed: int = SEED) -> DataFrame:
    """mix_name, source, doc_id, tokens, copies of every record that a mix takes at least once."""
    planned = F.broadcast(_plan_table(sized, entries).where("repeats > 0"))  # at most MAX_TARGETS rows
    # the fraction is taken by a seeded hash of mix and record, spread over [0, 1)
    draw = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor("repeats") + (draw < F.col("repeats") - F.floor("repeats")).cast("long")
    return sized.join(planned, "source").withColumn("copies", copies.cast("int")).where("copies > 0").select("mix_name", "source", "doc_id", "tokens", "copies")


def shares(sized: DataFrame, entries: list[dict], seed: int = SEED) -> DataFrame:
    """One row per mix and source: target and actual share of the mix's tokens, and what was taken."""
    taken = mix(sized, entries, seed).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    rows = F.broadcast(_plan_table(sized, entries)).join(taken, ["mix_name", "source"], "left").fillna(0, ["taken_tokens", "records", "most_copies"])
    totals = rows.groupBy("mix_name").agg(F.sum("taken_tokens").alias("total"))
    return rows.join(totals, "mix_name").select("mix_name", "source", "target_share", F.when(F.col("total") > 0, F.col("taken_tokens") / F.col("total")).otherwise(0.0).alias("actual_share"), "held_tokens", "taken_tokens", "records", "most_copies", "max_repeats")

"""Which records of a pool are one work: keys by DOI and title, and an ordered fold of the records that share one."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

LEAST_TITLE = 6
#: Ends that say nothing of a title; a parameter of title_key().
TAILS = ("研究", "分析", "综述", "初探", "探讨", "探析", "浅析", "综述与展望", "研究进展", "及其应用", "areview", "asurvey", "acasestudy")
POOL = "pos long, engine string, id string, title string, doi string, abstract string"


def doi_key(value: Column) -> Column:
    """The first DOI in a text, folded, without the signs that follow it; empty for none."""
    runs = F.regexp_extract_all(T.folded(F.coalesce(value, F.lit(""))), F.lit(r"10\.[a-z0-9._/;()-]*"), F.lit(0))
    cut = F.transform(runs, lambda x: F.regexp_replace(x, r"[.,;:/?!)\]\"']+$", ""))
    return F.coalesce(F.get(F.filter(cut, lambda x: x.rlike(r"^[^/]+/.")), 0), F.lit(""))


def title_key(title: Column, tails: Sequence[str] = TAILS, least: int = LEAST_TITLE) -> Column:
    """The letters and digits of a title, folded, without empty ends as long as enough is left."""
    key = F.regexp_replace(T.compact(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{Nd}]", "")
    ends = "|".join(sorted(tails, key=len, reverse=True))
    return F.regexp_replace(key, rf"^(.{{{least},}}?)(?:{ends})+$", "$1") if tails else key


def paper_key(doi: Column, title: Column) -> Column:
    """The DOI, else the title behind t:, else nothing."""
    d, t = doi_key(doi), title_key(title)
    return F.when(d != "", d).when(t != "", F.concat(F.lit("t:"), t)).otherwise("")


def keyed(pool: DataFrame) -> DataFrame:
    """pool with doi_key and title_key; a title that is too short is none."""
    rows = pool.withColumns({"doi_key": doi_key(F.col("doi")), "title_key": title_key(F.col("title"))})
    return rows.withColumn("title_key", F.when(F.length("title_key") >= LEAST_TITLE, F.col("title_key")).otherwise(""))


def blocks(pool: DataFrame, most_rounds: int = 20) -> DataFrame:
    """pool with block: records that share a DOI or a title, or are linked by such, have one. The least position spreads over both keys until nothing changes."""
    rows = keyed(pool).withColumn("block", F.col("pos"))
    for _ in range(most_rounds):
        least = F.col("block")
        for key in ("doi_key", "title_key"):
            own = rows.filter(F.col(key) != "").groupBy(F.col(key).alias("k")).agg(F.min("block").alias("low"))
            rows = rows.join(own, F.col(key) == F.col("k"), "left").withColumn("block", F.least(least, F.coalesce("low", least))).drop("k", "low")
        open_ = rows.filter("doi_key <> ''").groupBy("doi_key").agg(F.countDistinct("block").alias("n")).filter("n > 1").limit(1).count()
        open_ += rows.filter("title_key <> ''").groupBy("title_key").agg(F.countDistinct("block").alias("n")).filter("n > 1").limit(1).count()
        if not open_:
            return rows
    raise RuntimeError(f"blocks are not settled after {most_rounds} rounds")


def fold(records: list[dict[str, Any]]) -> list[tuple[int, int, str]]:
    """(pos, kept pos, why) of the records of a block, in order.

    A record joins the work of its DOI, else that of its title unless both have a DOI and they differ, or one source gave them
    two numbers. Of two records the one with an abstract stays, then the longer abstract, then the longer title, then the first."""
    works: list[dict[str, Any]] = []
    by: dict[tuple[str, str], dict[str, Any]] = {}
    joined: list[tuple[int, dict[str, Any], str]] = []

    def strength(r: dict[str, Any]) -> tuple[bool, int, int]:
        n = len("".join((r["abstract"] or "").split()))
        return n > 0, n, len(r["title"] or "")

    for r in sorted(records, key=lambda r: r["pos"]):
        work, why = (by.get(("doi", r["doi_key"])), "doi") if r["doi_key"] else (None, "")
        if work is None and r["title_key"] and (hit := by.get(("title", r["title_key"]))):
            kept = hit["kept"]
            two = bool(r["id"] and kept["id"]) and (r["engine"] or "") == (kept["engine"] or "") and r["id"] != kept["id"]
            if not two and (not hit["doi"] or not r["doi_key"] or hit["doi"] == r["doi_key"]):
                work, why = hit, "title"
        if work is None:
            work, why = {"kept": r, "doi": r["doi_key"], "title": r["title_key"]}, "new"
            works.append(work)
        else:
            if strength(r) > strength(work["kept"]):
                work["kept"] = {**r, "id": r["id"] or work["kept"]["id"], "engine": r["engine"] or work["kept"]["engine"]}
            else:
                work["kept"] = {**work["kept"], "id": work["kept"]["id"] or r["id"], "engine": work["kept"]["engine"] or r["engine"]}
            work["doi"] = work["kept"]["doi_key"] or work["doi"]
            work["title"] = work["kept"]["title_key"] or work["title"]
        joined.append((r["pos"], work, why))
        if work["doi"]:
            by["doi", work["doi"]] = work
        if work["title"]:
            by["title", work["title"]] = work
    return [(pos, work["kept"]["pos"], why) for pos, work, why in joined]


def resolved(pool: DataFrame) -> DataFrame:
    """pos, kept (the position of the record that stands for the work), why. pool: POOL; positions differ."""

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(rows.astype(object).where(rows.notna(), None).to_dict("records")), columns=["pos", "kept", "why"])

    rows = blocks(pool)
    lone = rows.filter("doi_key = '' and title_key = ''").select("pos", F.col("pos").alias("kept"), F.lit("new").alias("why"))
    some = rows.filter("doi_key <> '' or title_key <> ''").groupBy("block").applyInPandas(kernel, "pos long, kept long, why string")
    return some.unionByName(lone)


def planned(ranked: DataFrame, cap: int, budget: int) -> DataFrame:
    """engine, pos, score, rank: at most so many of each engine by score, then so many in all, numbered. ranked: engine, pos, score."""
    own = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("score"), "pos"))
    rows = ranked.withColumn("own", own).filter(F.col("own") <= cap).drop("own")
    first = rows.orderBy(F.desc("score"), "pos").limit(budget)  # the budget bounds what is numbered
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pos")).cast("long"))

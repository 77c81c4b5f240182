"""Checks on generated answers: numbers without evidence, citations, grading, and result-set comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.graph import components
from tillwatch.functions.prefix import numbered
from tillwatch.functions.tables import union_on
from tillwatch.session import write_shared

# fixed values: they decide which numbers count
NUMBER = r"\d+(?:[.,]\d+)*%?"
CITATION = r"\[\d+(?:\s*,\s*\d+)*\]"
SMALL_NUMBERS = [str(i) for i in range(11)]


def numbers_in(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(C.col(text), F.lit(NUMBER), F.lit(0)))


def ungrounded_numbers(answer: str | Column, evidence: Column) -> Column:
    """Numbers of the answer that occur in no evidence text; citations and 0 to 10 do not count and a percent sign is
    not required in the evidence. ``evidence`` is an array of texts."""
    allowed = F.array_union(
        F.flatten(F.transform(evidence, lambda t: F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))),
        F.array(*[F.lit(n) for n in SMALL_NUMBERS]))
    used = numbers_in(F.regexp_replace(C.col(answer), CITATION, ""))
    bare = lambda n: F.regexp_replace(n, "%+$", "")
    return F.array_sort(F.filter(used, lambda n: ~F.array_contains(allowed, n) & ~F.array_contains(allowed, bare(n))))


def valid_citations(cited: str | Column, hits: str | Column) -> Column:
    """Distinct citations in order that point at one of the retrieved passages."""
    return F.array_sort(F.array_distinct(F.filter(C.col(cited), lambda i: (i >= 1) & (i <= C.col(hits)))))


def answer_status(found: Column, bad_numbers: Column) -> Column:
    return F.when(~found, "not_found").when(F.size(bad_numbers) > 0, "blocked").otherwise("answered")


def grade_answers(answers: DataFrame) -> DataFrame:
    """Answers (status, citations, answer, sources, must_include): right when answered, cited and complete; questions
    without sources must be declined."""
    text = F.lower(F.coalesce("answer", F.lit("")))
    complete = F.forall("must_include", lambda s: F.contains(text, F.lower(s)))
    good = (F.col("status") == "answered") & (F.size("citations") > 0) & complete
    return answers.withColumn("correct", F.when(F.size("sources") > 0, good).otherwise(F.col("status") == "not_found"))


def share_correct(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("answers"), F.count_if("correct").alias("correct"), C.rate("correct").alias("share"))


def value_sets(df: DataFrame) -> DataFrame:
    """Each row as the set of its values, without names and order; numbers rounded to three digits."""
    cells = []
    for name, t in df.dtypes:
        number = t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or t.startswith("decimal")
        c = F.round(F.col(name).cast("double"), 3) if number else F.col(name)
        cells.append(F.coalesce(c.cast("string"), F.lit("None")))
    return df.select(F.array_sort(F.array_distinct(F.array(*cells))).alias("row"))


def _augment(need: dict, room: dict, edges: dict) -> bool:
    """Can every gold row have ``need`` predicted rows of its own? Augmenting paths over ``edges`` (gold -> predicted), ``room`` of each."""
    given: dict = {p: {} for p in room}
    for start, units in need.items():
        while units:
            via, queue, end = {start: None}, [start], None
            seen: dict = {}
            while queue and end is None:
                g = queue.pop()
                for p in edges[g]:
                    if p in seen:
                        continue
                    seen[p] = g
                    if room[p] > 0:
                        end = p
                        break
                    for other, n in given[p].items():
                        if n > 0 and other not in via:
                            via[other] = p
                            queue.append(other)
            if end is None:
                return False
            path, p = [], end  # (gold, takes from, gives back to the one before)
            while p is not None:
                g = seen[p]
                path.append((g, p, via[g]))
                p = via[g]
            amount = min(units, room[end], *(given[back][g] for g, _, back in path if back is not None))
            for g, p, back in path:
                given[p][g] = given[p].get(g, 0) + amount
                if back is not None:
                    given[back][g] -= amount
            room[end] -= amount
            units -= amount
    return True


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    edges: dict = {}
    for g, p in zip(rows["g"], rows["p"]):
        edges.setdefault(g, []).append(p)
    ok = _augment(dict(zip(rows["g"], rows["need"])), dict(zip(rows["p"], rows["room"])), edges)
    return pd.DataFrame({"case": rows["case"].iloc[:0 if ok else 1]})


#: Rounds in which rows with a single partner are settled by joins, before what is left is solved component by component.
FORCED_ROUNDS = 8


def match_cases(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """case, match: do the predicted rows of each case contain its gold rows, one by one? Both tables have case and row (array of values).

    The row counts must be equal, and the gold rows must be assigned to different predicted rows that hold all their values (and maybe more).
    Equal rows are one node with a count. A gold row meets the predicted rows that hold its rarest value, so unrelated rows form no
    pair. Rows with a single partner take it, round by round; what remains ambiguous falls into connected components, and each is
    solved by augmenting paths in a task of its own.
    """
    g, p = (write_shared(numbered(df.groupBy("case", "row").agg(F.count(F.lit(1)).alias("n")), [F.col("case"), F.col("row")], "id"), "answers")
            for df in (gold, predicted))
    count = lambda df, name: df.groupBy("case").agg(F.sum("n").alias(name))
    totals = count(g, "n_gold").join(count(p, "n_predicted"), "case", "full")
    totals = write_shared(totals.select("case", F.col("n_gold").eqNullSafe(F.col("n_predicted")).alias("match")), "totals")
    open_cases = totals.where("match").select("case")
    need = g.join(open_cases, "case").select("case", F.col("id").alias("g"), "row", F.col("n").alias("need"))
    room = p.join(open_cases, "case").select("case", F.col("id").alias("p"), F.col("row").alias("wide"), F.col("n").alias("room"))
    held = room.select("case", "p", F.explode("wide").alias("value"))
    often = held.groupBy("case", "value").agg(F.count(F.lit(1)).alias("n"))
    rarest = need.select("case", "g", F.explode("row").alias("value")).join(often, ["case", "value"], "left").groupBy("case", "g").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "value")).alias("v")).select("g", F.col("v.value").alias("value"))
    met = need.join(rarest, "g").join(held, ["case", "value"]).join(room.select("p", "wide"), "p")
    edges = write_shared(met.where(F.size(F.array_except("row", "wide")) == 0).select("case", "g", "p"), "edges")
    need, room = need.drop("row"), room.drop("wide")
    lost = []
    for _ in range(FORCED_ROUNDS):
        partners = edges.groupBy("g").agg(F.count(F.lit(1)).alias("partners"), F.min("p").alias("p"))
        need = write_shared(need.join(partners, "g", "left"), "needed")
        lost.append(need.where("partners IS NULL").select("case"))
        forced = need.where("partners = 1")
        if forced.isEmpty():
            break
        taken = forced.groupBy("p").agg(F.sum("need").alias("taken"))
        room = write_shared(room.join(taken, "p", "left").select("case", "p", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")), "room")
        lost.append(room.where("room < 0").select("case"))
        edges = write_shared(edges.join(forced.select("g"), "g", "left_anti").join(room.where("room > 0").select("p"), "p", "left_semi"), "edges")
        need = need.where("partners > 1").select("case", "g", "need")
        if need.isEmpty():
            break
    if not edges.isEmpty():
        labels = components(edges.select((F.col("g") * 2).alias("a"), (F.col("p") * 2 + 1).alias("b")))
        core = edges.join(need.select("g", "need"), "g").join(room.select("p", "room"), "p").join(labels.toDF("a", "label"), F.col("g") * 2 == F.col("a"))
        lost.append(core.select("case", "g", "p", "need", "room", "label").groupBy("label").applyInPandas(_solve, core.select("case").schema))
    failed = union_on(lost, "case").distinct().withColumn("failed", F.lit(True))
    return totals.join(failed, "case", "left").select("case", (F.col("match") & F.col("failed").isNull()).alias("match"))


def results_match(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: do the predicted rows contain the gold rows, one by one? See ``match_cases``; two empty results match."""
    one = lambda df: value_sets(df).select(F.lit(0).alias("case"), "row")
    found = match_cases(one(gold), one(predicted))
    return found.agg(F.coalesce(F.bool_and("match"), F.lit(True)).alias("match"))

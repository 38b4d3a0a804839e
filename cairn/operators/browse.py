"""Facet drill-down over the tag layer: axes ranked by entropy, labels, universal tags, one recommended step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import ranking
from cairn.operators import tags

AXES, VALUES, LABEL_TERMS, PREVIEW = 4, 8, 5, 5
#: Universal tags that a view shows at most.
UNIVERSAL = 64

Tag = tuple[str, str]


def selection(tagged: DataFrame, chosen: list[Tag]) -> DataFrame:
    """tagged rows of the selected files. All later steps read these rows, so callers that take several keep them."""
    return tagged if not chosen else tagged.join(tags.select_all(tagged, chosen), "file_id", "left_semi")


def matched(selected: DataFrame) -> DataFrame:
    return selected.select("file_id").distinct().agg(F.count("*").alias("matched"))


def value_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("namespace", "value").agg(F.count("*").alias("n_files"))


def namespace_coverage(selected: DataFrame) -> DataFrame:
    return selected.select("namespace", "file_id").distinct().groupBy("namespace").agg(F.count("*").alias("covered"))


def _offered(selected: DataFrame, chosen: list[Tag]) -> DataFrame:
    """Values that are neither chosen nor universal, with matched: the steps that narrow."""
    counts = value_counts(selected).join(F.broadcast(matched(selected)))  # one row
    return _without(counts, chosen).where(F.col("n_files") < F.col("matched"))


def _without(rows: DataFrame, chosen: list[Tag]) -> DataFrame:
    for namespace, value in chosen:
        rows = rows.where(~((F.col("namespace") == namespace) & (F.col("value") == value)))
    return rows


def _placed(offered: DataFrame, values: int) -> DataFrame:
    """The first `values` values of each namespace with their place; the others go before namespaces are shuffled."""
    order = W.partitionBy("namespace").orderBy(F.desc("n_files"), "value")
    return offered.withColumn("place", F.row_number().over(order)).where(F.col("place") <= values)


def axes(selected: DataFrame, chosen: list[Tag] = (), values: int = VALUES) -> DataFrame:
    """namespace, n_values, covered, matched, score_key, coverage_key, best axis first. An axis' score is the entropy, in bits, of its first `values` values, the rest of its assignments as one, and the files without it, over all of these; axes that no value narrows are left out."""
    offered = _offered(selected, chosen)
    sums = offered.groupBy("namespace", "matched").agg(F.count("*").alias("n_values"), F.sum("n_files").alias("assigned"))
    tops = _placed(offered, values).groupBy("namespace").agg(F.sort_array(F.collect_list("n_files")).alias("tops"), F.sum("n_files").alias("shown"))  # at most `values` entries
    sums = sums.join(tops, "namespace").withColumn("tail", F.col("assigned") - F.col("shown")).join(namespace_coverage(selected), "namespace")
    residue = F.greatest(F.col("matched") - F.col("assigned"), F.lit(0))
    whole = (F.col("assigned") + residue).cast("double")
    every = F.concat(F.col("tops"), F.array("tail"), F.array(residue))
    score = F.aggregate(every, F.lit(0.0), lambda acc, c: acc + ranking.bits(c / whole))
    out = sums.select("namespace", "n_values", "covered", "matched", ranking.rank_key(score).alias("score_key"), ranking.rank_key(F.col("covered") / F.col("matched")).alias("coverage_key"))
    return out.orderBy(F.desc("score_key"), F.desc("coverage_key"), F.desc("n_values"), "namespace")


def multi_valued(selected: DataFrame) -> DataFrame:
    """namespace, multi: whether some file has several values of it, so that shares add up to more than the whole."""
    n = selected.groupBy("namespace").agg(F.count("*").alias("n"))
    return n.join(namespace_coverage(selected), "namespace").select("namespace", (F.col("n") > F.col("covered")).alias("multi"))


def axis_values(selected: DataFrame, chosen: list[Tag] = (), values: int = VALUES) -> DataFrame:
    """namespace, value, n_files, place: each axis' first values."""
    return _placed(_offered(selected, chosen), values).select("namespace", "value", "n_files", "place").orderBy("namespace", "place")


def universal(selected: DataFrame, chosen: list[Tag] = ()) -> DataFrame:
    """Tags that every selected file has; they lead nowhere."""
    counts = _without(value_counts(selected).join(F.broadcast(matched(selected))), chosen)
    return counts.where(F.col("n_files") >= F.col("matched")).select("namespace", "value").orderBy("namespace", "value")


def label(tagged: DataFrame, selected: DataFrame, chosen: list[Tag] = (), terms: int = LABEL_TERMS) -> DataFrame:
    """namespace, value, weight_key: the tags by which the selection stands out from the corpus. Corpus counts are taken for the selection's vocabulary alone."""
    counts = _without(value_counts(selected), chosen)
    assigned = counts.agg(F.sum("n_files").alias("assigned"))
    corpus = tagged.select("file_id").distinct().agg(F.count("*").alias("corpus"))
    df = tagged.join(counts.select("namespace", "value"), ["namespace", "value"], "left_semi").groupBy("namespace", "value").agg(F.count("*").alias("df"))
    rows = counts.join(df, ["namespace", "value"]).join(F.broadcast(assigned)).join(F.broadcast(corpus))  # one row each
    weight = ranking.rank_key(ranking.label_weight(F.col("n_files").cast("double"), F.col("assigned"), F.col("corpus"), F.col("df")))
    return rows.select("namespace", "value", weight.alias("weight_key")).orderBy(F.desc("weight_key"), "namespace", "value").limit(terms)


def recommended(selected: DataFrame, chosen: list[Tag] = (), n_axes: int = AXES, values: int = VALUES) -> DataFrame:
    """The one shown value whose choice tells most: most bits, then fewer files, then the smaller tag."""
    shown = axes(selected, chosen, values).limit(n_axes).select("namespace")
    rows = _placed(_offered(selected, chosen), values).join(shown, "namespace", "left_semi")
    rows = rows.withColumn("bits_key", ranking.rank_key(ranking.step_bits(F.col("n_files"), F.col("matched"))))
    return rows.select("namespace", "value", "n_files", "bits_key").orderBy(F.desc("bits_key"), "n_files", "namespace", "value").limit(1)


def preview(selected: DataFrame, files: int = PREVIEW) -> DataFrame:
    return selected.select("file_id").distinct().orderBy("file_id").limit(files)


@dataclass
class View:
    """One step of a drill-down, small enough to print."""

    chosen: list[Tag]
    matched: int
    axes: list
    values: list
    universal: list
    label: list
    recommended: Tag | None
    preview: list[int]
    multi: list[str]


def browse(tagged: DataFrame, chosen: list[Tag] = (), n_axes: int = AXES, values: int = VALUES, label_terms: int = LABEL_TERMS, files: int = PREVIEW) -> View:
    """A whole view. The selection is kept while its parts are taken."""
    chosen = list(dict.fromkeys(chosen))
    s = selection(tagged, chosen).persist()
    try:
        shown = axes(s, chosen, values).limit(n_axes).collect()
        names = [a.namespace for a in shown]
        step = recommended(s, chosen, n_axes, values).first()
        return View(
            chosen, matched(s).first().matched, shown,
            axis_values(s, chosen, values).where(F.col("namespace").isin(names)).collect() if names else [],
            [(u.namespace, u.value) for u in universal(s, chosen).limit(UNIVERSAL).collect()],
            [(t.namespace, t.value) for t in label(tagged, s, chosen, label_terms).collect()],
            (step.namespace, step.value) if step else None, [r.file_id for r in preview(s, files).collect()],
            sorted(r.namespace for r in multi_valued(s).where(F.col("namespace").isin(names)).where("multi").collect()) if names else [],
        )
    finally:
        s.unpersist()

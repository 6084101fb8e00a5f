"""Categories of labels by taxonomies of any number of names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import normalised_label
from brindle.functions.vocab import CUSTOM_CODE, CUSTOM_KEY
from brindle.session import written

#: Names that one automaton holds, so that what is sent to the tasks stays small; more are found by a join.
MOST_NAMES = 50_000
#: Characters by which names that may stand anywhere meet labels.
GRAM = 6


class Names:
    """The least priority of the names that a normalised label is, or that stand anywhere in it.

    Names that may stand anywhere are in one Aho-Corasick automaton, which reads a label once however many there are.
    """

    def __init__(self, rows: list[tuple[int, str, bool]]):
        import ahocorasick

        self.whole: dict[str, int] = {}
        self.automaton, best = ahocorasick.Automaton(), {}
        for priority, name, anywhere in rows:
            for form in (name, name.replace(" ", "")):
                self.whole[form] = min(priority, self.whole.get(form, priority))
            if anywhere and name:
                best[name] = min(priority, best.get(name, priority))
        for name, priority in best.items():
            self.automaton.add_word(name, priority)
        if best:
            self.automaton.make_automaton()
        self.searched = bool(best)

    def priority(self, label: str) -> int | None:
        found = [self.whole[x] for x in (label, label.replace(" ", "")) if x in self.whole]
        if self.searched:
            found += [p for _, p in self.automaton.iter(label)]
        return min(found, default=None)


def canonical_labels(labels: DataFrame, taxonomy: DataFrame, label: str = "label", most_names: int = MOST_NAMES) -> DataFrame:
    """`labels` with smell_key, smell_type and code of their category.

    `taxonomy` has rows of priority (whole numbers, the least wins), smell_key,
    smell_type, code and synonym; a category's rows repeat all but the synonym.
    A category fits as in `functions.text.canonical_smell`: the label is its key or a synonym,
    with or without spaces, or has a synonym in it. Null labels are empty;
    empty and null synonyms fit nothing but a label like them. A label that
    fits none is a custom smell under its own name. Up to `most_names`
    names are sent to the tasks in one automaton; more are joined with the labels.
    """
    distinct = labels.select(F.col(label).alias("_label")).distinct().withColumn("_norm", normalised_label(F.col("_label")))
    keys = taxonomy.select("priority", F.replace("smell_key", F.lit("_"), F.lit(" ")).alias("name"), F.lit(False).alias("anywhere"))
    names = keys.unionByName(taxonomy.select("priority", F.col("synonym").alias("name"), F.lit(True).alias("anywhere"))).filter("name IS NOT NULL").distinct()
    many = names.count() > most_names
    if many:
        found = _joined(distinct, names)
    else:
        rows = [tuple(r) for r in names.select("priority", "name", "anywhere").collect()]
        found = distinct.withColumn("_priority", F.lit(None).cast("int")).mapInPandas(_searcher(rows), "_label string, _norm string, _priority int")
    categories = taxonomy.groupBy(F.col("priority").alias("_priority")).agg(F.first("smell_key").alias("smell_key"), F.first("smell_type").alias("smell_type"), F.first("code").alias("code"))
    named = found.join(categories.hint("merge") if many else categories, "_priority", "left").select(
        "_label",
        F.coalesce("smell_key", F.lit(CUSTOM_KEY)).alias("smell_key"),
        F.coalesce("smell_type", F.concat(F.lit("Custom Tool Smell ("), F.coalesce("_label", F.lit("")), F.lit(")"))).alias("smell_type"),
        F.coalesce("code", F.lit(CUSTOM_CODE)).alias("code"),
    )
    return labels.join(named.hint("merge"), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def _grams(text: Column, size: Column) -> Column:
    """The different runs of `size` characters in a text."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _joined(labels: DataFrame, names: DataFrame) -> DataFrame:
    """_label, _norm, _priority of labels (_label, _norm) by any number of names.

    Names that are a label are found by equality. A name that stands in a label
    has all its runs of `GRAM` characters there (or is itself the run, if it is shorter), so the two meet
    by that run of the name which the fewest labels have; names with a run that no label has fall out.
    All joins are told to shuffle: both sides grow with the input, and their files are so much smaller
    than their rows that Spark would take a side for small and send it through the driver.
    """
    labels = written(labels.withColumn("_id", F.monotonically_increasing_id()), "labels")
    forms = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.replace(c, F.lit(" "), F.lit(""))))).alias("form")
    whole = names.select(forms("name"), "priority").groupBy("form").agg(F.min("priority").alias("priority"))
    equal = labels.select("_id", forms("_norm")).join(whole.hint("merge"), "form").select("_id", "priority")
    size = F.least(F.length("name"), F.lit(GRAM))
    anywhere = written(names.filter("anywhere AND name <> ''").groupBy("name").agg(F.min("priority").alias("priority")).withColumn("size", size), "names")
    sizes = [r[0] for r in anywhere.select("size").distinct().collect()]  # GRAM at most
    runs = F.flatten(F.array(*[_grams(F.col("_norm"), F.lit(s)) for s in sizes])) if sizes else F.array().cast("array<string>")
    grams = labels.select("_id", F.explode(runs).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("labels"))
    own = anywhere.select("name", "priority", F.explode(_grams(F.col("name"), F.col("size"))).alias("gram")).join(common.hint("merge"), "gram", "left")
    rarest = own.groupBy("name", "priority").agg(F.min(F.struct(F.coalesce("labels", F.lit(0)).alias("labels"), "gram")).alias("r")).filter("r.labels > 0")
    meet = grams.join(rarest.select(F.col("r.gram").alias("gram"), "name", "priority").hint("merge"), "gram").select("_id", "name", "priority")
    within = meet.join(labels.select("_id", "_norm").hint("merge"), "_id").filter(F.contains("_norm", "name")).select("_id", "priority")
    best = equal.unionByName(within).groupBy("_id").agg(F.min("priority").cast("int").alias("_priority"))
    return labels.join(best.hint("merge"), "_id", "left").select("_label", "_norm", "_priority")


def _searcher(rows: list[tuple[int, str, bool]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(rows)
        for pdf in frames:
            here = pdf["_norm"].map(names.priority)
            yield pdf.assign(_priority=pd.concat([pdf["_priority"], here], axis=1).min(axis=1).astype("Int32"))

    return run


def taxonomy_rows(spark, taxonomy: tuple) -> DataFrame:
    """A taxonomy of `functions.vocab` as rows."""
    rows = [(n, key, display, code, s) for n, (key, display, code, synonyms) in enumerate(taxonomy) for s in synonyms]
    return spark.createDataFrame(rows, "priority int, smell_key string, smell_type string, code string, synonym string")

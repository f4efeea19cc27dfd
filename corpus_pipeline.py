"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import SPACE, shared_folder, stored
from shoplens.llm.jaccard_join import jaccard_components
from shoplens.llm.language_id import UNKNOWN, identify, train
from shoplens.llm.mixing import mix, place
from shoplens.llm.packing import digest, pack
from shoplens.llm.secrets import scan

ORACLE_SQL = None
BLOCK = 128


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows under positional names, so that no column can clash with an operator's own, and those names in order."""
    known = ("doc_id", "text", "lang", "source")
    names = [c if c in known else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def _named(df: DataFrame, docs: DataFrame, names: list[str], text: Column | None = None) -> DataFrame:
    """Back to the columns of ``docs``; with a new text, ``n_chars`` counts its code points."""
    out = []
    for name, old in zip(names, docs.columns):
        c = df[name]
        if text is not None:
            c = text if name == "text" else F.length(text).cast(docs.schema[old].dataType) if old == "n_chars" else c
        out.append(c.alias(old))
    return df.select(*out)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_share: float = 0.5) -> DataFrame:
    """Language ID: documents in no learned language, or with less than ``min_share`` of any one, go; the others stay as they are.

    The model is learned from all rows of ``docs`` with a language. Without any such row no document is rejected.
    """
    plain, names = _plain(docs)
    model = train(plain)
    if not model.languages:
        return docs
    found = identify(plain, model)
    return _named(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_share)), docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each group the document with the smallest id stays.

    Rows without an id stay. Of rows that share an id one stays.
    """
    groups = jaccard_components(docs, words=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return rest
    twice = stored(twice, "twice")
    first = rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(first.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every found span is replaced by a mark; all documents stay."""
    plain, names = _plain(docs)
    found = scan(plain, redacted=True)
    return _named(found, docs, names, found["clean"])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document once for every time that a part of it is drawn, with the words of the drawn blocks.

    A document drawn whole keeps its text; of others the drawn words are joined by blanks. Documents with no drawn word go.
    """
    plain, names = _plain(docs)
    numbered = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    rows, slots = mix(numbered, block=BLOCK, row="row")
    parts = place(rows, slots, BLOCK).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "uses"))).alias("parts"), F.max("uses").alias("copies")
    )
    drawn = numbered.join(parts, "row").join(rows.select("row", "size"), "row")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    drawn = drawn.withColumn("own", F.filter("parts", lambda p: p["uses"] >= F.col("copy")))
    taken = F.aggregate("own", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.array_join(F.flatten(F.transform("own", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " "),
        ), 1,
    )
    return _named(drawn, docs, names, F.when(taken == F.col("size"), F.col("text")).otherwise(cut))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all sequences, with checksums of their ids."""
    return digest(pack(docs))


STAGES = [
    ("language_id", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs

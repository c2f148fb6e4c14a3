"""Sources and sinks: set catalogs (GMT files, dicts), ranked lists, expression data, metadata, result caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.operators.ordering import Ranges

SETS = T.StructType([T.StructField("pathway", T.StringType()), T.StructField("gene", T.StringType())])
RANKED = T.StructType([T.StructField("gene", T.StringType()), T.StructField("score", T.DoubleType())])


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, description, genes) of a GMT file: tab-separated name, description and members.

    Lines are stripped; those with fewer than three fields are skipped; of lines with one name the last counts. A line's place is its
    block and offset as Spark's reader gives them, so the file is read by parts but never gathered.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"))
    fields = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    parsed = lines.select("place", fields.alias("f")).where(F.size("f") >= 3)
    last = parsed.groupBy(F.col("f")[0].alias("pathway")).agg(F.max_by("f", "place").alias("f"))
    return last.select("pathway", F.col("f")[1].alias("description"), F.expr("slice(f, 3, size(f) - 2)").alias("genes"))


def write_gmt(wide: DataFrame, path: str) -> None:
    """Write (pathway, genes[, description]) as GMT lines; a missing description is NA."""
    note = F.coalesce(F.col("description"), F.lit("NA")) if "description" in wide.columns else F.lit("NA")
    wide.select(F.concat_ws("\t", "pathway", note, F.concat_ws("\t", "genes")).alias("value")).write.mode("overwrite").text(path)


def sets_from_dict(spark: SparkSession, sets: Mapping[str, Iterable[str]]) -> DataFrame:
    """(pathway, gene) of a dict of member lists."""
    return spark.createDataFrame([(str(k), str(g)) for k, genes in sets.items() for g in genes], SETS)


def exploded(wide: DataFrame) -> DataFrame:
    """(pathway, gene) of (pathway, genes)."""
    return wide.select("pathway", F.explode("genes").alias("gene"))


def catalog(spark: SparkSession, sets: DataFrame | Mapping | str) -> DataFrame:
    """Distinct (pathway, gene) of a dict, a GMT path, or a wide or long DataFrame."""
    if isinstance(sets, str):
        sets = exploded(read_gmt(spark, sets))
    elif isinstance(sets, Mapping):
        sets = sets_from_dict(spark, sets)
    elif "genes" in sets.columns:
        sets = exploded(sets)
    return sets.select(F.col("pathway").cast("string").alias("pathway"), F.col("gene").cast("string").alias("gene")).where("pathway is not null and gene is not null").distinct()


def scores_of(spark: SparkSession, data: DataFrame | pd.DataFrame | pd.Series | Mapping, gene_col: str | int = 0, score_col: str | int = 1) -> DataFrame:
    """(gene string, score double) of a DataFrame (columns by name or place), a Series (index = gene) or a dict."""
    if isinstance(data, pd.Series):
        data = pd.DataFrame({"gene": data.index.astype(str), "score": data.to_numpy(dtype=float)})
        gene_col, score_col = "gene", "score"
    elif isinstance(data, Mapping):
        return spark.createDataFrame([(str(k), float(v)) for k, v in data.items()], RANKED)
    if isinstance(data, pd.DataFrame):
        g, s = (data.columns[c] if isinstance(c, int) else c for c in (gene_col, score_col))
        data = spark.createDataFrame(pd.DataFrame({"gene": data[g].astype(str), "score": data[s].astype(float)}), RANKED)
        gene_col, score_col = "gene", "score"
    g, s = (data.columns[c] if isinstance(c, int) else c for c in (gene_col, score_col))
    return data.select(F.col(f"`{g}`").cast("string").alias("gene"), F.col(f"`{s}`").cast("double").alias("score"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """Long expression (cell_id, gene, value) of a Parquet or CSV path with those columns, absent cells being 0."""
    raw = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return raw.select(F.col("cell_id").cast("string").alias("cell_id"), F.col("gene").cast("string").alias("gene"), F.col("value").cast("double").alias("value"))


def melted(wide: DataFrame, cell_col: str = "cell_id") -> DataFrame:
    """Long non-zero expression of a wide table with one column for each gene."""
    genes = [c for c in wide.columns if c != cell_col]
    pairs = F.array(*[F.struct(F.lit(c).alias("gene"), F.col(f"`{c}`").cast("double").alias("value")) for c in genes])
    return wide.select(F.col(cell_col).cast("string").alias("cell_id"), F.explode(pairs).alias("p")).select("cell_id", "p.gene", "p.value").where("value <> 0")


def merge_metadata(cells: DataFrame, meta: DataFrame, key: str = "cell_id", positional: bool = False, order: str | None = None) -> DataFrame:
    """Cells with metadata columns: joined by key, or by place in `order` if asked for and both have as many rows.

    Metadata columns that cells already have are left out. Places are found by ranges of the order on both sides, in all tasks; missing values come first.
    """
    if not positional:
        extra = [c for c in meta.columns if c == key or c not in cells.columns]
        return cells.join(meta.select(*extra).dropDuplicates([key]), key, "left")
    by = [F.col(order or key).isNotNull(), F.col(order or key)]
    left, right = Ranges(cells, by), Ranges(meta, by)
    if left.total != right.total:
        return cells
    extra = [c for c in meta.columns if c not in cells.columns]
    placed = right.placed.withColumn("__place", right.places()).select("__place", *extra)
    return left.placed.withColumn("__place", left.places()).drop("__range").join(placed, "__place").drop("__place")


def write_result(result: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result as CSV, TSV (lower-case names, pval) or Parquet."""
    if fmt == "tsv":
        named = result.toDF(*[c.lower().replace("p-value", "pval") for c in result.columns])
        named.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    elif fmt == "csv":
        result.write.mode("overwrite").option("header", True).csv(path)
    else:
        result.write.mode("overwrite").parquet(path)


def fingerprint(rows: DataFrame) -> str:
    """A number for the rows of a table, whatever their order: count and sums of row hashes, made in one pass. Maps don't count."""
    columns = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    h = F.xxhash64(*columns)
    found = rows.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 40))), F.sum(F.pmod(F.shiftrightunsigned(h, 24), F.lit(1 << 40)))).first()
    return "-".join(str(x or 0) for x in found)


def cached(spark: SparkSession, folder: str, params: Mapping, make, force: bool = False, inputs: Iterable[DataFrame] = ()) -> DataFrame:
    """The result of make() from Parquet under a hash of its parameters and of the rows of its inputs, made and written when it isn't there or force is set."""
    held = {"params": params, "inputs": [fingerprint(x) for x in inputs]}
    digest = hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/result-{digest}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Write (gene, score) as tab-separated lines in falling order, without a header."""
    ranks.select("gene", "score").orderBy(F.desc("score"), "gene").write.mode("overwrite").option("sep", "\t").csv(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(gene, score) of tab-separated lines without a header."""
    return spark.read.schema(RANKED).option("sep", "\t").csv(path)

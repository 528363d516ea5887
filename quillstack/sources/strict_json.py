"""Strict JSON and record sources: validated documents, page text, tree walks, path checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.geometry import scaled_box

#: Limits of one imported file.
MAX_BYTES, MAX_DEPTH, MAX_VALUES = 100 * 1024 * 1024, 128, 1_000_000


def strict_load(data: bytes):
    """Parsed JSON, or ValueError: too large, a byte order mark, bad UTF-8, repeated keys, NaN or depth."""
    if len(data) > MAX_BYTES:
        raise ValueError("too large")
    if data[:3] == b"\xef\xbb\xbf":
        raise ValueError("byte order mark")

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def constant(name: str):
        raise ValueError(f"not finite: {name}")

    try:
        value = json.loads(data.decode("utf-8"), object_pairs_hook=unique, parse_constant=constant)
    except RecursionError as e:
        raise ValueError("too deep") from e
    seen, level = 0, [value]
    for _ in range(MAX_DEPTH + 1):
        seen += len(level)
        if seen > MAX_VALUES:
            raise ValueError("too many values")
        level = [child for v in level if isinstance(v, (dict, list)) for child in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("too deep")


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


VERDICT = T.StructType([T.StructField("json", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(VERDICT)
def strict_json(data: pd.Series) -> pd.DataFrame:
    """Canonical JSON and its hash, or the reason a file is refused; null stays null."""
    rows = []
    for raw in data:
        try:
            text = None if raw is None else canonical(strict_load(bytes(raw)))
            rows.append((text, None if text is None else hashlib.sha256(text.encode()).hexdigest(), None))
        except ValueError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["json", "sha256", "error"])


def read_strict_json(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, json, sha256, error for every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), strict_json("content").alias("v")).select("path", "bytes", "v.*")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a fixed schema: blank lines skipped, a bad line fails the read."""
    return spark.read.schema(schema).json(path, lineSep="\n", mode="FAILFAST")


def pages_of(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, page (from 1), text: form feeds end pages; a blank last page is dropped."""
    parts = F.split(F.col(text), "\f")
    last = F.element_at(parts, -1).rlike(r"^(?U)\s*$")
    kept = F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return texts.select(id_col, F.posexplode(kept).alias("p", text)).select(id_col, (F.col("p") + 1).alias("page"), text)


@udtf(returnType="pointer string, type string, bbox array<double>, image_path string, depth int")
class WalkTree:
    """Every object of a JSON text that has a box or an image, with its JSON pointer.

    The tree is walked with an explicit stack, so depth is a limit and no recursion error.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        seen, stack = 0, [("", json.loads(text), 0)]
        while stack:
            pointer, value, depth = stack.pop()
            seen += 1
            if depth > MAX_DEPTH or seen > MAX_VALUES:
                raise ValueError(f"too deep or too large at {pointer}")
            if isinstance(value, dict):
                if "bbox" in value or value.get("image_path") is not None:
                    box = value.get("bbox")
                    yield pointer, value.get("type"), None if box is None else [float(x) for x in box], value.get("image_path"), depth
                children = [(str(k).replace("~", "~0").replace("/", "~1"), v) for k, v in value.items()]
            elif isinstance(value, list):
                children = [(str(i), v) for i, v in enumerate(value)]
            else:
                continue
            stack.extend((f"{pointer}/{k}", v, depth + 1) for k, v in reversed(children))


def walk_tree(spark: SparkSession, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    spark.udtf.register("walk_tree", WalkTree)
    docs.createOrReplaceTempView("_walk_docs")
    return spark.sql(f"select d.`{id_col}`, w.* from _walk_docs d, lateral walk_tree(d.`{text}`) w")


def valid_content_box(box: Column) -> Column:
    """Four whole numbers in 0 .. 1000 that span an area."""
    whole = F.forall(box, lambda v: (v >= 0) & (v <= 1000) & (v == F.floor(v)))
    return F.coalesce((F.size(box) == 4) & whole & (F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1)), F.lit(False))


def valid_page_box(box: Column, size: Column) -> Column:
    """Four finite numbers inside the page that span an area."""
    finite = F.forall(box, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0))
    inside = (F.get(box, 2) <= F.get(size, 0)) & (F.get(box, 3) <= F.get(size, 1))
    return F.coalesce((F.size(box) == 4) & finite & inside & (F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1)), F.lit(False))


def safe_path(path: Column) -> Column:
    """Relative, without .. parts, backslashes or NUL."""
    return ~(path.rlike(r"^/|^[A-Za-z]:|\\|\x00") | F.exists(F.split(path, "/"), lambda p: p.isin("..", ".", "")))


#: Which tree types may be the evidence of a content type.
COMPATIBLE = {
    "text": ["text", "title", "index", "list"], "equation": ["interline_equation"], "image": ["image", "image_body"],
    "chart": ["chart", "chart_body"], "table": ["table", "table_body"], "code": ["code", "algorithm"], "list": ["list", "index", "ref_text"],
    "header": ["header"], "footer": ["footer"], "page_number": ["page_number"], "aside_text": ["aside_text"], "page_footnote": ["page_footnote"],
}


def match_tree(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """item, matches, status, pointer: content items (item, page, type, bbox) against tree nodes (page,
    type, bbox in points, size, pointer) by page, scaled box and compatible type."""
    spark = items.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in COMPATIBLE.items() for b in bs], "type string, tree_type string")
    scaled = nodes.select("page", F.col("type").alias("tree_type"), scaled_box(F.col("bbox"), F.col("size")).alias("bbox"), "pointer").join(F.broadcast(pairs), "tree_type")
    hit = items.join(scaled, ["page", "type", "bbox"], "left").groupBy("item").agg(F.count("pointer").alias("matches"), F.min("pointer").alias("pointer"))
    status = F.when(F.col("matches") == 1, "exact").when(F.col("matches") > 1, "ambiguous").otherwise("unmatched")
    return hit.select("item", "matches", status.alias("status"), F.when(F.col("matches") == 1, F.col("pointer")).alias("pointer"))

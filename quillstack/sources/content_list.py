"""Parser content lists: a flat JSON array of page items becomes ordered blocks.

One row per document comes in as JSON text; items are exploded with their positions, and each kind
of item contributes its blocks by one array expression, so an import is a projection and two
explodes. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import node_id, sha256_text

_S, _L = T.StringType(), T.ArrayType(T.StringType())
ITEM = T.StructType(
    [T.StructField(n, _S) for n in ("id", "type", "sub_type", "text", "text_format", "img_path", "table_body", "code_body")]
    + [T.StructField("text_level", T.IntegerType()), T.StructField("page_idx", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, _L) for n in ("list_items", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "table_caption", "table_footnote", "code_caption", "code_footnote")]
)
#: Item types, and those whose text is page furniture.
TYPES = ["text", "equation", "image", "chart", "table", "code", "list", "header", "footer", "page_number", "aside_text", "page_footnote"]
AUXILIARY = ["header", "footer", "page_number", "aside_text", "page_footnote"]
BLOCK = "array<struct<sub:int,field:string,suffix:string,source:string,kind:string,translatable:boolean,role:string,visual:boolean>>"


def items_of(docs: DataFrame, id_col: str = "document_id", text: str = "content") -> DataFrame:
    """document, item (zero-based), page_order, is_title and the item's fields."""
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.from_json(text, T.ArrayType(ITEM))).alias("item", "v")).select("document_id", "item", "v.*")
    page = Window.partitionBy("document_id", "page_idx").orderBy("item")
    seen = F.sum(F.when(F.col("text_level") > 0, 1).otherwise(0)).over(Window.partitionBy("document_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("page_order", F.row_number().over(page)).withColumn("is_title", F.coalesce((F.col("text_level") > 0) & (seen == 1), F.lit(False)))


def _block(sub: int, field: str, suffix: str, source: Column, kind: str, may: Column | bool, role: Column | str, visual: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(sub).alias("sub"), F.lit(field).alias("field"), F.lit(suffix).alias("suffix"), source.alias("source"), F.lit(kind).alias("kind"), lit(may).alias("translatable"), lit(role).alias("role"), lit(visual).alias("visual"))


def _notes(base: int, name: str, field: str, role: Column | str) -> Column:
    lit = role if isinstance(role, Column) else F.lit(role)
    made = F.transform(
        F.coalesce(F.col(field), F.array().cast("array<string>")),
        lambda s, i: F.struct(
            (i + base).alias("sub"),
            F.concat(F.lit(f"{field}/"), i.cast("string")).alias("field"),
            F.format_string(f"{name}-%02d", i + 1).alias("suffix"),
            s.alias("source"),
            F.lit("caption").alias("kind"),
            F.lit(True).alias("translatable"),
            F.concat(lit, F.lit(f"_{name}")).alias("role"),
            F.lit(False).alias("visual"),
        ),
    )
    return made.cast(BLOCK)


def _of_item(policy: dict[str, str]) -> Column:
    """The blocks of one item, by its type."""
    kind = F.col("type")
    level, image = F.coalesce(F.col("text_level"), F.lit(0)), F.col("img_path")
    role = F.when(F.col("is_title"), "title").when(level > 0, "heading").otherwise("paragraph")
    text = F.when(level > 0, F.array(_block(0, "text", "", F.col("text"), "heading", True, role))).otherwise(F.array(_block(0, "text", "", F.col("text"), "prose", True, role)))
    equation = F.array(_block(0, "text", "", F.col("text"), "math", False, F.when(image.isNotNull(), "equation_visual").otherwise("equation"), image.isNotNull()))

    def picture(name: str) -> Column:
        own = F.array(_block(0, "img_path", "", F.lit(""), "image", False, name, True)).cast(BLOCK)
        return F.concat(own, _notes(100, "caption", f"{name}_caption", name), _notes(200, "footnote", f"{name}_footnote", name))

    body = _block(0, "table_body", "", F.col("table_body"), "table", False, "table")
    shot = _block(1, "img_path", "visual", F.lit(""), "image", False, "table_visual", True)
    alone = _block(0, "img_path", "", F.lit(""), "image", False, "table_visual", True)
    has_body, has_image = F.col("table_body").isNotNull(), image.isNotNull()
    tables = F.when(has_body & has_image, F.array(body, shot).cast(BLOCK)).when(has_body, F.array(body).cast(BLOCK)).otherwise(F.array(alone).cast(BLOCK))
    table = F.concat(tables, _notes(100, "caption", "table_caption", "table"), _notes(200, "footnote", "table_footnote", "table"))
    code = F.concat(F.array(_block(0, "code_body", "", F.col("code_body"), "code", False, F.col("sub_type"))).cast(BLOCK), _notes(100, "caption", "code_caption", F.col("sub_type")), _notes(200, "footnote", "code_footnote", F.col("sub_type")))
    listed = F.array(_block(0, "list_items", "", F.concat(F.lit("- "), F.array_join("list_items", "\n- ")), "list", True, "reference"))
    ruled = F.coalesce(*[F.when(kind == t, F.lit(p)) for t, p in policy.items()], F.when(kind == "page_footnote", "bilingual"), F.lit("artifact-omitted"))
    furniture = F.when(ruled == "artifact-omitted", F.array(_block(0, "text", "", F.col("text"), "artifact", False, kind))).otherwise(F.array(_block(0, "text", "", F.col("text"), "prose", ruled == "bilingual", kind)))
    out = F.when(kind == "text", text.cast(BLOCK)).when(kind == "equation", equation.cast(BLOCK)).when(kind == "image", picture("image")).when(kind == "chart", picture("chart"))
    return out.when(kind == "table", table).when(kind == "code", code).when(kind == "list", listed.cast(BLOCK)).when(kind.isin(AUXILIARY), furniture.cast(BLOCK))


def blocks_of(items: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """document, ord, id, page, bbox, source, source_sha256, kind, translatable, adapter_role,
    caption_parent and is_visual of every block, in reading order.

    policy maps page furniture types to bilingual, source-only or artifact-omitted.
    """
    rows = items.withColumn("b", F.explode(_of_item(policy or {}))).select("document_id", "item", "page_idx", "page_order", "bbox", "type", "b.*")
    pointer = F.concat(F.lit("/"), F.col("item").cast("string"), F.lit("/"), F.col("field"))
    base = node_id(F.col("page_idx") + 1, F.col("page_order"), [F.col("document_id").cast("string"), pointer, F.col("source")])
    named = rows.withColumn("id", F.concat(base, F.when(F.col("suffix") != "", F.concat(F.lit("-"), F.col("suffix"))).otherwise("")))
    first = F.first("id").over(Window.partitionBy("document_id", "item").orderBy("sub"))
    return named.select(
        "document_id", (F.col("item").cast("long") * 1000 + F.col("sub")).alias("ord"), "item", "id", (F.col("page_idx") + 1).alias("page"), "bbox", "source", sha256_text(F.col("source")).alias("source_sha256"), "kind", "translatable",
        F.col("role").alias("adapter_role"), F.when(F.col("kind") == "caption", first).alias("caption_parent"), F.col("visual").alias("is_visual"),
    )


def item_faults(items: DataFrame) -> DataFrame:
    """document, item, fault: what makes an item unfit for import; none means it is sound."""
    doc = Window.partitionBy("document_id").orderBy("item")
    items = items.withColumn("_previous", F.lag("page_idx").over(doc))
    previous = F.col("_previous")
    blank = lambda c: F.col(c).isNull() | F.col(c).rlike(r"^\s*$|\x00")
    box = F.col("bbox")
    good_box = F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1000)) & (F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1)), F.lit(False))
    kind = F.col("type")
    tests = {
        "unsupported type": ~F.coalesce(kind.isin(TYPES), F.lit(False)),
        "page out of order": previous > F.col("page_idx"),
        "bad page": F.col("page_idx").isNull() | (F.col("page_idx") < 0),
        "bad box": ~good_box,
        "text missing": kind.isin("text", "equation", *AUXILIARY) & blank("text"),
        "image missing": kind.isin("image", "chart") & blank("img_path"),
        "table without body or image": (kind == "table") & blank("table_body") & blank("img_path"),
        "unsupported subtype": ((kind == "code") & ~F.coalesce(F.col("sub_type").isin("code", "algorithm"), F.lit(False))) | ((kind == "list") & ~F.coalesce(F.col("sub_type") == "ref_text", F.lit(False))) | (F.col("sub_type").isNotNull() & ~kind.isin("image", "chart", "code", "list")),
        "bad text level": F.col("text_level") < 0,
    }
    faults = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return items.withColumn("fault", F.explode(faults)).select("document_id", "item", "fault")

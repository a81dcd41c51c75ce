"""Label files of any size read as many tasks, in both layouts: one object of items, or one object a line.

Spark's text source cuts a file at commas, so its splits work inside one long object too. Whether a comma
parts two items depends on all text before it, by two numbers only: the parity of quotes and the depth of
brackets. Both add up, so a split works out what it does to them for either state it may start in, and one
small row a split carries the state over to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import materialize
from quillspark.sources.files import decode_ignoring

#: Values above this many characters are taken as they are, without a look at their syntax.
CHECKED_CHARACTERS = 16 << 20

_MEMBER = r'(?s)^\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*(.*?)\s*$'
#: An object that ends where another begins: valid JSON has this between top-level objects only.
_NEXT_OBJECT = r"(?<=\})\s*\n\s*(?=\{)"


def _depth(text: Column, first: int) -> Column:
    """Brackets opened minus closed in every second part of ``text`` between quotes, from the given one on."""
    outside = F.array_join(F.filter(F.split(text, '"', -1), lambda _, i: i % 2 == first), "")
    count = lambda marks: F.length(F.regexp_replace(outside, f"[^{marks}]", ""))
    return (count(r"\{\[") - count(r"\}\]")).cast("long")


def label_pieces(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """``path, block, at, piece, plain, turned, plus, plus_in`` of the pieces between commas of the files below ``root``.

    ``at`` orders the pieces of a split (``block``), ``plain`` tells those that begin an object after another.
    ``turned`` is 1 where a piece leaves the state (in a string or not) other than it was, ``plus`` and ``plus_in``
    are what it adds to the depth when it starts outside or inside a string.
    """
    lines = spark.read.option("lineSep", ",").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root)
    raw = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), decode_ignoring(F.col("value").cast("binary")).alias("value"),
    )
    cut = raw.select("path", "block", "row", F.posexplode(F.split("value", _NEXT_OBJECT)).alias("sub", "piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return cut.select(
        "path", "block", F.struct("row", "sub").alias("at"), "piece", (F.col("sub") > 0).alias("plain"),
        (quotes % 2).cast("long").alias("turned"), _depth(bare, 0).alias("plus"), _depth(bare, 1).alias("plus_in"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``member``, the place where their member begins, ``object``, where its object does, and ``wrong``."""
    upto = Window.partitionBy("path", "block").orderBy("at")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    seen = pieces.withColumn("_in", F.coalesce(F.sum("turned").over(before), zero) % 2)
    for state in (0, 1):  # depth inside the split, for both states it may begin in
        add = F.when(F.col("_in") == state, F.col("plus")).otherwise(F.col("plus_in"))
        seen = seen.withColumn(f"_add{state}", add)
    for state in (0, 1):
        seen = seen.withColumn(f"_depth{state}", F.coalesce(F.sum(f"_add{state}").over(before), zero))
    seen = materialize(seen)

    # one row a split: what it does, and by the splits before it the state and depth it begins in
    splits = seen.groupBy("path", "block").agg(
        (F.sum("turned") % 2).alias("_turn"), F.sum("_add0").alias("_sum0"), F.sum("_add1").alias("_sum1"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.withColumn("_state", F.coalesce(F.sum("_turn").over(earlier), zero) % 2)
    begun = begun.withColumn("_sum", F.when(F.col("_state") == 0, F.col("_sum0")).otherwise(F.col("_sum1")))
    begun = begun.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), zero))
    known = seen.join(begun.select("path", "block", "_state", "_base"), ["path", "block"])
    inside = (F.col("_in") + F.col("_state")) % 2 == 1
    depth = F.col("_base") + F.when(F.col("_state") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))
    place = F.struct("block", "at")
    first = (F.col("block") == 0) & (F.row_number().over(upto) == 1)
    known = known.select(
        "path", "block", "at", "piece", "plain", place.alias("_place"), first.alias("_first"),
        (first | (F.col("plain") & ~inside & (depth == 0))).alias("_opens"), (~F.col("plain") & ~inside & (depth == 1)).alias("_parts"),
        # a comma, or an object that is no new one, where no object is open
        (~first & ~inside & F.when(F.col("plain"), depth != 0).otherwise(depth <= 0)).alias("wrong"),
    )
    begins = F.when(F.col("_opens") | F.col("_parts"), F.col("_place"))
    opens = F.when(F.col("_opens"), F.col("_place"))
    known = materialize(known.withColumn("member", F.last(begins, True).over(upto)).withColumn("object", F.last(opens, True).over(upto)))
    ends = known.groupBy("path", "block").agg(F.max("member").alias("_m"), F.max("object").alias("_o")).select(
        "path", "block", F.max("_m").over(earlier).alias("_m"), F.max("_o").over(earlier).alias("_o"))
    out = known.join(ends, ["path", "block"]).select(
        "path", "_place", "piece", "plain", F.coalesce("member", "_m").alias("member"), F.coalesce("object", "_o").alias("object"), "wrong")
    total = begun.groupBy("path").agg((F.sum("_turn") % 2).alias("_state"), F.sum("_sum").alias("_depth"))
    return out.join(total.where("_state != 0 OR _depth != 0").select("path", F.lit(True).alias("_open")), "path", "left").withColumn(
        "wrong", F.col("wrong") | F.coalesce("_open", F.lit(False))).drop("_open")


def stored_label_members(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """``path, item, value, error, line`` of the label files below ``root``: ``files.label_members`` for files of any size.

    A file is one JSON object of items, or one object a line. An object with a text member ``item`` is one entry of
    that name (what ``sinks.result_rows`` writes, ``line`` is true); any other is an object of items. Of repeated
    names in a file the last counts. A file that cannot be read gives one row with ``error`` and no items; Spark lists
    no files of zero bytes. What must fit into memory is one item, never a file.
    """
    where = F.col("_metadata.file_path").alias("_file")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    listed = materialize(listed.select("path", where))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "plain", "piece"))), lambda p: F.concat(
        F.when(p["plain"], "\n").otherwise(","), p["piece"])), "")
    joined = _placed(label_pieces(spark, root, suffix)).groupBy("path", "object", "member").agg(
        F.substring(text, 2, 2**31 - 1).alias("text"), F.bool_or("wrong").alias("wrong"))
    joined = materialize(joined)
    ends = joined.groupBy("path", "object").agg(F.max("member").alias("_last"))
    opening, closing = F.col("member") == F.col("object"), F.col("member") == F.col("_last")
    inner = F.when(opening, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    inner = F.when(closing, F.regexp_replace(inner, r"\}\s*$", "")).otherwise(inner)
    cut = joined.join(ends, ["path", "object"]).select(
        "path", "object", "member", inner.alias("text"),
        (F.col("wrong") | (opening & ~F.col("text").rlike(r"^\s*\{")) | (closing & ~F.col("text").rlike(r"\}\s*$"))).alias("wrong"),
        (opening & closing).alias("_only"),
    ).where("wrong OR NOT _only OR NOT text RLIKE '^\\\\s*$'")  # the empty object has no items
    name, value = F.regexp_extract("text", _MEMBER, 1), F.regexp_extract("text", _MEMBER, 2)
    item = F.get(F.from_json(F.concat(F.lit("["), F.col("name"), F.lit("]")), "array<string>"), F.lit(0))
    parsed = cut.select("path", "object", "member", "text", "wrong", name.alias("name"), value.alias("value")).withColumn("item", item)
    large = F.length("value") > CHECKED_CHARACTERS
    alone = F.concat(F.lit("["), F.col("value"), F.lit("]"))  # so that nothing may follow the value
    sound = large | F.try_parse_json(alone).isNotNull() | F.get_json_object(alone, "$").isNotNull()
    sound = (F.col("value") != "") & sound
    members = materialize(parsed.select(
        "path", "object", "member", "text", "item", "value", (F.col("wrong") | F.col("item").isNull() | ~sound).alias("wrong")))

    bad = members.where("wrong").select("path").distinct().withColumn("error", F.lit("not JSON objects of items"))
    good = members.join(bad, "path", "left_anti")
    own = F.get(F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>"), F.lit(0))
    entries = good.where((F.col("item") == "item") & F.col("value").startswith('"')).groupBy("path", "object").agg(F.max_by(own, "member").alias("_name"))
    named = good.join(entries, ["path", "object"]).groupBy("path", "object", "_name").agg(F.concat(
        F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "text"))), lambda m: m["text"]), ","), F.lit("}")
    ).alias("value")).select("path", F.col("_name").alias("item"), "value", F.col("object").alias("_at"), F.lit(True).alias("line"))
    items = good.join(entries, ["path", "object"], "left_anti").select("path", "item", "value", F.col("member").alias("_at"), F.lit(False).alias("line"))
    last = named.unionByName(items).groupBy("path", "item").agg(F.max_by(F.struct("value", "line"), "_at").alias("m"))
    rows = last.select("path", "item", "m.value", F.lit(None).cast("string").alias("error"), "m.line").unionByName(bad.select(
        "path", F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("value"), "error", F.lit(False).alias("line")))
    return rows.withColumnRenamed("path", "_file").join(listed, "_file").select("path", "item", "value", "error", "line")

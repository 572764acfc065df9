"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is an array of parts ``struct<kind, text, ref, width, height, seconds, pages>``.
The visitor flattens the parts of a turn in order: text is escaped and copied, every other part
becomes the placeholder ``<kind:n>`` (n counts the attachments of the conversation) and is recorded
with its reference and with the number of tokens a model expands it to.

Template: ``<turn role>TEXT</turn>`` and a line feed.  The escape maps ``\\`` to ``\\s``, ``<`` to
``\\l`` and ``>`` to ``\\g``, so that in the output an angle bracket is always the template's own;
undoing the three in reverse order restores any text exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens an attachment expands to: one for each image tile of this many pixels a side,
#: and so many for a second of audio and for a page of a document.
IMAGE_TILE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A content array that holds one text part (null text: empty)."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")).cast(PART))


def expanded_tokens(part: Column) -> Column:
    """Tokens of an attachment; missing sizes count as one tile, second or page."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / IMAGE_TILE)
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * DOCUMENT_PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask, attachments, expanded_tokens``.

    ``loss_mask`` lists, in order of turns, the code-point range ``struct<start, length>`` of each
    assistant turn's text in ``formatted``.  ``attachments`` lists ``struct<ordinal, turn, kind, ref,
    tokens>``.  Rows with the same turn number stand by role, then content, and repeated rows stay.
    Null turn numbers come first, null roles and null parts are empty, null conversation ids form one
    conversation, other columns are ignored, and an empty table gives no row.
    """
    visit = lambda ps: F.filter(F.coalesce(ps, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    flat = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("parts")).alias("t"))
    # one row a task and conversation leaves the map side: collect_list merges partial lists
    grouped = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    none = F.array().cast("array<struct<turn:bigint,kind:string,ref:string,tokens:bigint>>")
    files = F.flatten(F.transform("ts", lambda t: F.transform(F.filter(t["parts"], lambda p: ~is_text(p)), lambda p: F.struct(t["turn"].cast("long").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))))
    # attachments before a turn: running count, one pass over the turns
    counts = F.transform("ts", lambda t: F.size(F.filter(t["parts"], lambda p: ~is_text(p))))
    grouped = grouped.withColumn("files", F.coalesce(files, none)).withColumn("counts", counts)
    before = F.transform("ts", lambda t, i: F.when(F.size("files") == 0, 0).otherwise(F.aggregate(F.slice("counts", 1, i), F.lit(0), lambda a, x: a + x)))
    grouped = grouped.withColumn("before", before)

    def content(t: Column, i: Column) -> Column:
        ordinal = lambda k: F.get("before", i) + F.size(F.filter(F.slice(t["parts"], 1, k + 1), lambda q: ~is_text(q)))
        piece = lambda p, k: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), p["kind"], F.lit(":"), ordinal(k).cast("string"), F.lit(">")))
        return F.array_join(F.transform(t["parts"], piece), "")

    heads = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"))
    body = grouped.withColumn("body", F.transform("ts", lambda t, i: F.struct(t["role"].alias("role"), heads(t).alias("head"), content(t, i).alias("text"))))
    body = body.withColumn("sizes", F.transform("body", lambda b: F.struct((F.length(b["head"]) + F.length(b["text"]) + F.length(F.lit("</turn>\n"))).cast("long").alias("all"), F.length(b["head"]).cast("long").alias("head"), F.length(b["text"]).cast("long").alias("text"), (b["role"] == "assistant").alias("on"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))
    step = lambda a, s: F.struct((a["at"] + s["all"]).alias("at"), F.when(s["on"], F.concat(a["mask"], F.array(F.struct((a["at"] + s["head"]).alias("start"), s["text"].alias("length"))))).otherwise(a["mask"]).alias("mask"))
    return body.select(
        "conv_id",
        F.array_join(F.transform("body", lambda b: F.concat(b["head"], b["text"], F.lit("</turn>\n"))), "").alias("formatted"),
        F.aggregate("sizes", start, step, lambda a: a["mask"]).alias("loss_mask"),
        F.transform("files", lambda f, i: F.struct((i + 1).cast("long").alias("ordinal"), f["turn"].alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, unescaped."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")
    after = lambda x: F.substring(x, F.lit(7), F.length(x))  # noqa: E731  behind "<turn "
    role = lambda x: F.substring_index(x, ">", 1)
    one = lambda y: F.struct(unescape(role(y)).alias("role"), unescape(F.substring(y, F.length(role(y)) + 2, F.length(y))).alias("text"))
    return F.transform(turns, lambda x: one(after(x)))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped: assistant texts in order with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")

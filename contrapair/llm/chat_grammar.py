"""Chat formatting checked by a grammar round trip, in DataFrame expressions only.

    conversation := "<s>" turn*
    turn         := "<|" role "|>" text "</s>"

Neither role nor text holds a bare control string. A turn is rendered as it is and read back by the grammar; where what is
read differs from the source, because the content holds a control string or the escape mark, its content is escaped and
the turn is rendered again. The whole conversation is then read back once more and must be identical to the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a trained template treats as control strings. None holds the escape mark or overlaps itself.
CONTROLS = ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARK = "\\"
OPEN, HEAD, CLOSE_HEAD, END = "<s>", "<|", "|>", "</s>"
BARE = "|".join(rf"\Q{c}\E" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Doubles the mark, then puts one behind the first character of each control string."""
    out = F.replace(text, F.lit(MARK), F.lit(MARK * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + MARK + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """A doubled mark is one, a single one is none."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(CLOSE_HEAD), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null where it doesn't follow the grammar."""
    body = F.substr(formatted, F.lit(len(OPEN) + 1))
    pieces = F.split(body, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last end mark is checked below

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(HEAD) + 1))
        role = F.substring_index(inner, CLOSE_HEAD, 1)
        text = F.substr(inner, F.length(role) + len(CLOSE_HEAD) + 1)
        well = piece.startswith(HEAD) & inner.contains(CLOSE_HEAD) & ~role.rlike(BARE) & ~text.rlike(BARE)
        return F.when(well, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(pieces, turn)
    well = formatted.startswith(OPEN) & (F.endswith(formatted, F.lit(END)) | (formatted == OPEN))
    return F.when(well & F.forall(turns, lambda t: t.isNotNull()), turns)


def trained_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, cut from the formatted conversation and unescaped span by span; no span gives the empty text."""
    cut = F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")


def format_conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, *, trained_role: str = "assistant") -> DataFrame:
    """conv, formatted (string), turns (array of role, text read back from it), loss_spans (array of start, end).

    ``loss_spans`` are code points of ``formatted``, counted from 0, that hold the texts of the trained role in escaped form.

    * Null roles and texts count as empty; rows without a conversation id form one conversation without id.
    * Turns stand in order of turn (null first), then role, then text; repeated rows stay repeated turns.
    * A conversation's text is one value by nature, so one conversation must fit a task; many turns of others don't meet it.
    * An empty table gives no rows. Other columns are not looked at.
    * A conversation that still differs after escaping stops the job: its data would be lost otherwise.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain = render(F.col("role"), F.col("text"))
    read = parse(F.concat(F.lit(OPEN), plain))
    rows = rows.withColumn("same", F.coalesce(read == source, F.lit(False)))
    rows = rows.withColumn("head", F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"))))
    rows = rows.withColumn("body", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("piece", render(F.col("head"), F.col("body")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + len(OPEN) - len(END))
    one = F.struct("place", "role", "text", "piece", (F.col("end") - F.length("body")).alias("start"), "end")
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    whole = whole.withColumn("formatted", F.concat(F.lit(OPEN), F.array_join(F.transform("parts", lambda p: p["piece"]), "")))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    checked = F.when(F.col("turns") == source, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    spans = F.transform(F.filter("parts", lambda p: p["role"] == trained_role), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv", "formatted", checked.alias("turns"), spans.alias("loss_spans"))

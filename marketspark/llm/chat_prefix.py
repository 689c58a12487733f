"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the template's control strings; each has a ``<`` or ``[``, which escaped texts never hold
BOS, EOS, TURN, SAYS, OPEN, CLOSE = "<s>", "</s>", "<|turn|>", "<|says|>", "[INST] ", " [/INST]"
#: character and its code; the backslash comes first when escaping and last when reading back
CODES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))


def escape(text: Column) -> Column:
    """Text without ``<`` and ``[``, so that no control string can appear in it."""
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: every backslash of an escaped text starts a code."""
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples (conv_id, example, trainable, context, target, mask_start, mask_chars).

    ``context`` holds the opening mark, all preceding turns and the target turn's head; ``target`` is the turn in its
    template. The mask covers the escaped reply without its end mark, counted in characters from the start of
    ``context || target``. Turns after the last reply (or a conversation without replies) make one closing example
    with an empty mask, so nothing of the input is lost.

    Null text is an empty text and a null role the role ''. Turns order by turn (null first), then role and text, so
    repeated turns keep a defined order and all stay; rows with a null conv_id are one conversation. An empty table
    gives no rows; other columns are ignored, whatever their names.

    A conversation is one row on the way, as its digest needs it whole. Examples are as long as the prefixes they
    show, so their total grows with turns times length of a conversation; the expansion asks for that.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def body(s: Column) -> Column:
        said = escape(s["text"])
        return F.when(s["role"] == "user", F.concat(F.lit(OPEN), said, F.lit(CLOSE))).otherwise(F.concat(said, F.lit(EOS)))
    c = c.select("conv_id", F.transform("ts", lambda s: F.struct(
        (s["role"] == "assistant").alias("reply"), F.concat(F.lit(TURN), escape(s["role"]), F.lit(SAYS)).alias("head"), body(s).alias("body"))).alias("rs"))
    c = c.select("*", F.transform("rs", lambda r: F.concat(r["head"], r["body"])).alias("whole"))
    x = c.select("*", F.posexplode("rs").alias("example", "r")).where(F.col("r.reply") | (F.col("example") == F.size("rs") - 1))
    x = x.select("conv_id", "example", F.col("r.reply").alias("trainable"),
                 F.concat(F.lit(BOS), F.array_join(F.slice("whole", F.lit(1), F.col("example")), ""), F.col("r.head")).alias("context"), F.col("r.body").alias("target"))
    return x.select("*", F.length("context").alias("mask_start"), F.when(F.col("trainable"), F.length("target") - len(EOS)).otherwise(0).alias("mask_chars"))


def masked(full: Column) -> Column:
    """The text under the loss mask of ``full = context || target``, unescaped."""
    return unescape(full.substr(F.col("mask_start") + 1, F.col("mask_chars")))


def read_turns(full: Column) -> Column:
    """The turns (role, text) of ``context || target``, read back."""
    def turn(part: Column) -> Column:
        role = F.substring_index(part, SAYS, 1)
        said = part.substr(F.length(role) + len(SAYS) + 1, F.length(part))
        user = unescape(role) == "user"
        skip, end = F.when(user, len(OPEN)).otherwise(0), F.when(user, len(CLOSE)).otherwise(len(EOS))
        return F.struct(unescape(role).alias("role"), unescape(said.substr(skip + 1, F.length(said) - skip - end)).alias("text"))
    marks = "".join("\\" + c if not c.isalnum() else c for c in TURN)
    return F.transform(F.slice(F.split(full, marks), 2, 1 << 30), turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation: turns and trained text read back from the examples, as counts and digests."""
    full = F.concat("context", "target")
    x = examples.select("conv_id", "example", F.length(full).alias("n"), F.struct("example", masked(full).alias("said")).alias("loss"), full.alias("full"))
    g = x.groupBy("conv_id").agg(F.max_by("full", "example").alias("last"), F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("n").alias("formatted_chars"), F.count("*").alias("n_examples"))
    g = g.select("*", read_turns(F.col("last")).alias("turns"), F.array_join(F.transform("loss", lambda s: s["said"]), "").alias("said"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"),
                    sha(F.col("said")).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), F.col("n_examples").cast("long").alias("n_examples"))

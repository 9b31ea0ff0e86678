"""Chat formatting with Spark expressions only.

A conversation's rows are sorted by (turn, role, text) with null turns first; null
roles and texts are empty strings. Adjacent turns of one role share a block:

    \\n<|im_start|>role\\n<|im_sep|>text(\\n<|im_next|>text)*\\n<|im_end|>

A control string inside a role or text gets a backslash before it, and reading back
takes one away again; as the template's own are always preceded by a line feed, the
two cannot be confused. Rows without conv_id form the conversation null; repeated rows
are turns of their own; other columns are ignored; an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Strings that chat templates give a meaning.
CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
START, SEP, NEXT, END = (f"\n{x}" for x in CONTROLS[:4])
#: Works in Java's and in RE2's regular expressions.
PATTERN = "(" + "|".join("".join(f"\\{c}" if c in "<>|[]/" and c not in "<>/" else c for c in x) for x in CONTROLS) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PATTERN, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + PATTERN, "$1")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E", -1)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once although it is used often."""
    return F.get(F.transform(F.array(value), then), 0)


#: Numbers of a stretch that is summed up at once.
STRETCH = 256


def before(sizes: Column) -> Column:
    """What comes before each number of an array, summed; by stretches, as an array that grows by one is copied each time."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found"))
    firsts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(sizes) - 1) / STRETCH).cast("int"), F.lit(0)))
    within = F.transform(firsts, lambda k: F.aggregate(F.slice(sizes, k * STRETCH + 1, F.lit(STRETCH)), start, add))
    whole = lambda parts: F.aggregate(parts, start, lambda s, p: add(s, p["at"]))["found"]
    moved = lambda b: F.flatten(F.transform(b["parts"], lambda p, k: F.transform(p["found"], lambda x: x + F.get(b["base"], k))))
    return let(within, lambda parts: let(F.struct(parts.alias("parts"), whole(parts).alias("base")), moved))


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: array of (begin, end, first_byte, last_byte).

    begin and end are the code points of each ``trained`` text in formatted, the others its bytes.
    Time grows with a conversation's length, not with its square.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))

    def merged(t: Column) -> Column:
        """Blocks of adjacent turns of one role: a slice from each turn that begins one."""
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

        def blocks(begin: Column) -> Column:
            one = lambda i, k: F.struct(F.get(t, i)["role"].alias("role"), F.transform(F.slice(t, i + 1, F.coalesce(F.get(begin, k + 1), F.size(t)) - i), lambda x: x["text"]).alias("texts"))
            return F.transform(begin, one)

        return let(begins, blocks)

    blocks = chats.select("conv_id", let(escaped, merged).alias("blocks"))
    written = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], NEXT), F.lit(END)))

    def places(b: Column) -> Column:
        """Of each text in a block what stands before it and after it, in code points, and its sizes."""
        head = lambda size: len(START) + size(b["role"]) + len(SEP)
        ends = F.size(b["texts"]) - 1
        one = lambda x, k: F.struct(
            F.when(k == 0, head(F.length)).otherwise(len(NEXT)).cast("bigint").alias("pre"), F.when(k == 0, head(F.octet_length)).otherwise(len(NEXT)).cast("bigint").alias("pre_bytes"),
            F.length(x).cast("bigint").alias("n"), F.octet_length(x).cast("bigint").alias("n_bytes"), F.when(k == ends, len(END)).otherwise(0).cast("bigint").alias("post"),
            (b["role"] == escape(F.lit(trained))).alias("trained"),
        )
        return F.transform(b["texts"], one)

    def mask(p: Column) -> Column:
        points = before(F.transform(p, lambda x: x["pre"] + x["n"] + x["post"]))
        octets = before(F.transform(p, lambda x: x["pre_bytes"] + x["n_bytes"] + x["post"]))

        def spans(at: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                a, b = F.get(at["points"], k) + x["pre"], F.get(at["octets"], k) + x["pre_bytes"]
                return F.struct(a.alias("begin"), (a + x["n"]).alias("end"), b.alias("first_byte"), (b + x["n_bytes"]).alias("last_byte"), x["trained"].alias("trained"))

            return F.transform(F.filter(F.transform(p, one), lambda x: x["trained"]), lambda x: F.struct(*[x[c].alias(c) for c in ("begin", "end", "first_byte", "last_byte")]))

        return let(F.struct(points.alias("points"), octets.alias("octets")), spans)

    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), let(F.flatten(F.transform("blocks", places)), mask).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array of (role, text): the turns that format_chats has written."""

    def turns(block: Column) -> Column:
        parts = _split(block, SEP)
        texts = _split(F.get(parts, 1).substr(F.lit(1), F.length(F.get(parts, 1)) - len(END)), NEXT)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(parts, 0)).alias("role"), unescape(t).alias("text")))

    pieces = _split(formatted, START)
    return F.flatten(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turns))


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    back = chats.select("conv_id", "formatted", "loss_mask", read_back(F.col("formatted")).alias("turns"))
    cut = lambda data, m: F.substring(data, (m["first_byte"] + 1).cast("int"), (m["last_byte"] - m["first_byte"]).cast("int")).cast("string")
    under = let(F.col("formatted").cast("binary"), lambda data: F.transform("loss_mask", lambda m: unescape(cut(data, m))))
    back = back.withColumn("loss", F.array_join(under, ""))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )

"""Chat formatting by a finite-state machine over roles. DataFrame functions only.

A declarative template names the marks of a turn and the control strings that
texts must not contain. Inside roles and texts the escape character is doubled
and put after the first character of every control string, so that no control
string of the output comes from a text, and one regular expression undoes it.

Edge cases: null role or text counts as empty; null turns come first; rows of
one turn number are ordered by role, then text; repeated rows all stay; an empty
table gives no rows; other columns are ignored; rows of a null conv_id form one
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESC = "\\"
#: Marks of a turn, control strings, machine: state -> role -> state. "loss" names the roles that are learned.
TEMPLATE = {
    "open": "<|im_start|>",
    "sep": "<|im_sep|>",
    "close": "<|im_end|>",
    "controls": ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"],
    "loss": ["assistant"],
    "start": "start",
    "machine": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    },
    "final": ["assistant"],
}
#: Turns of one conversation that are put together in the first step, by turn number.
CHUNK = 64


def escape(x: Column, template: dict = TEMPLATE) -> Column:
    x = F.replace(x, F.lit(ESC), F.lit(ESC * 2))
    for c in sorted(template["controls"], key=len, reverse=True):
        x = F.replace(x, F.lit(c), F.lit(c[0] + ESC + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def _machine(roles: Column, template: dict) -> Column:
    """Struct of the final state and the 1-based position of the first turn out of order (null: none)."""
    moves = [(f"{a}>{r}", b) for a, m in template["machine"].items() for r, b in m.items()]
    table_ = F.create_map(*[F.lit(x) for kv in moves for x in kv])
    zero = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc, role):
        to = F.try_element_at(table_, F.concat(acc["state"], F.lit(">"), role))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"] + 1)).alias("bad"),
        )

    return F.aggregate(roles, zero, step)


def format_chats(turns: DataFrame, template: dict = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id: formatted text, its segments with loss flags, the machine's verdict.

    segments: array<struct<text, loss>> whose texts joined are the formatted
    text. A long conversation is put together in two steps, first runs of
    `chunk` turn numbers and then these, so that the last step meets few rows.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segs = F.array(
        seg(F.concat(F.lit(template["open"]), escape(role, template), F.lit(template["sep"])), no),
        seg(escape(text, template), role.isin(template["loss"])),
        seg(F.lit(template["close"]), no),
    )
    rows = turns.select("conv_id", F.col("turn").alias("t"), role.alias("r"), text.alias("x"), segs.alias("s"))
    part = rows.groupBy("conv_id", F.floor(F.col("t") / chunk).alias("c")).agg(
        F.sort_array(F.collect_list(F.struct("t", "r", "x", "s"))).alias("a")
    )
    part = part.select("conv_id", "c", F.transform("a", lambda e: F.struct(e["r"].alias("r"), e["s"].alias("s"))).alias("a"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("c", "a"))).alias("p"))
    whole = whole.select("conv_id", F.flatten(F.col("p.a")).alias("a"))
    whole = whole.select(
        "conv_id",
        F.size("a").cast("long").alias("n_turns"),
        F.flatten(F.col("a.s")).alias("segments"),
        _machine(F.col("a.r"), template).alias("m"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("m.bad").isNull() & F.col("m.state").isin(template["final"])).alias("valid"),
        F.col("m.bad").alias("first_bad_turn"),
    )


def parse_chats(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Read a formatted text back: array<struct<role, text>>."""
    close, sep = template["close"], template["sep"]
    turns = F.split(formatted, "\\Q" + close + "\\E")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    head = len(template["open"])
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, sep, 1), head + 1, 1 << 30)).alias("role"),
            unescape(F.substring(t, F.length(F.substring_index(t, sep, 1)) + F.lit(len(sep) + 1), F.lit(1 << 30))).alias("text"),
        ),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted one, formatted and read back."""
    both = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(both).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_chats(turns)
    back = parse_chats(F.col("formatted"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    t = TEMPLATE
    esc = lambda c: f"replace({c}, '{ESC}', '{ESC * 2}')"

    def escaped(c):
        x = esc(c)
        for k in sorted(t["controls"], key=len, reverse=True):
            x = f"replace({x}, '{k}', '{k[0] + ESC + k[1:]}')"
        return x

    moves = ", ".join(f"('{a}', '{r}')" for a, m in t["machine"].items() for r in m)
    fixed = len(t["open"] + t["sep"] + t["close"])
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(role) OVER w, '{t["start"]}') AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN ({moves}) AND (k < n OR role IN ('assistant'))) AS valid
FROM o GROUP BY conv_id"""


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": _sql()}

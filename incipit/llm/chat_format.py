"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

The machine's state is the role of the turn before, so turn order is a list of allowed (state, role) steps. A conversation
is cut in chunks of `chunk_turns` turns; each chunk reports its first and last role and its first bad step, chunks are
then joined by conversation. So a conversation of any number of turns is sorted and formatted chunk by chunk; only its
final text (whose digest is asked for) meets in one row. Conversations within one chunk skip the second grouping.

A text cannot break out of its turn: each backslash is doubled and each control string gets a backslash after its first
character, which reading back undoes.

Edge cases: null text and null role count as empty strings; a role the template does not know is written with a generic
marker and makes the conversation invalid; rows are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order; repeated rows are repeated turns; rows without conv_id form one conversation; an empty table
gives no rows; extra columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incipit.scale import cut, small


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written, and whether its text counts in the loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: Allowed steps of the machine: state (the role before, "" at the start) to the roles that may follow.
    steps: dict[str, tuple[str, ...]]
    #: States in which a conversation may end.
    final: tuple[str, ...]
    other: tuple[str, str, str] = ("<<TURN>>", "<<TEXT>>", "<</TURN>>")
    escape: str = field(default="\\")

    def controls(self) -> list[str]:
        return [c for t in self.turns.values() for c in (t.opens, t.closes)] + list(self.other)


INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    steps={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def escaped(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(c[0] + t.escape + c[1:])), t.controls(), text)


def unescaped(text: Column, t: Template) -> Column:
    e = re.escape(t.escape)
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def by_role(role: Column, t: Template, known, other: Column) -> Column:
    return reduce(lambda x, r: x.when(role == r, known(t.turns[r])), t.turns, F.when(F.lit(False), other)).otherwise(other)


def segments_of(turns: Column, t: Template) -> Column:
    """array<struct<role, text>> to array<struct<text, loss>>: the opening marker, the text and the closing marker of each turn."""

    def three(turn: Column) -> Column:
        role = turn["role"]
        return F.array(
            F.struct(by_role(role, t, lambda x: F.lit(x.opens), F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"], t).alias("text"), by_role(role, t, lambda x: F.lit(x.loss), F.lit(False)).alias("loss")),
            F.struct(by_role(role, t, lambda x: F.lit(x.closes), F.lit(t.other[2])).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, three))


def step_ok(state: Column, role: Column, t: Template) -> Column:
    return reduce(lambda x, s: x.when(state == s, role.isin(*t.steps[s])), t.steps, F.when(F.lit(False), F.lit(False))).otherwise(False)


def format_chats(rows: DataFrame, template: Template = INSTRUCT, chunk_turns: int = 4096) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid (turn order), one row per conversation."""
    t = template
    rows = rows.select("conv_id", F.floor(F.col("turn") / chunk_turns).alias("chunk"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    # Conversations with turns beyond the first chunk: found by a scan of two columns, mostly none. Rows part before they are
    # grouped, so each row is shuffled once, and rows of long conversations a second time as chunks.
    rows = rows.withColumn("key", F.struct("conv_id"))
    long = small(cut(rows.where("chunk <> 0 or chunk is null").select("key").distinct(), "chat-long"))

    def chunked(part: DataFrame) -> DataFrame:
        return (
            part.groupBy("conv_id", "chunk")
            .agg(F.sort_array(F.collect_list("t")).alias("turns"))
            .select("conv_id", "chunk", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
            .withColumn("steps_ok", F.forall(F.zip_with(F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0))), F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(1))), lambda a, b: step_ok(a["role"], b["role"], t)), lambda x: x))
            .select("conv_id", "chunk", segments_of(F.col("turns"), t).alias("segments"), F.get("turns", F.lit(0))["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"), "steps_ok")
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        )

    done = lambda d, inner: d.select("conv_id", "formatted", "segments", (inner & step_ok(F.lit(""), F.col("first"), t) & F.col("last").isin(*t.final)).alias("valid"))
    one = done(chunked(rows.join(long, "key", "left_anti")), F.col("steps_ok"))
    many = (
        chunked(rows.join(long, "key", "left_semi"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "formatted", "segments", "first", "last", "steps_ok"))).alias("c"))
        .select(
            "conv_id",
            F.array_join(F.col("c.formatted"), "").alias("formatted"),
            F.flatten("c.segments").alias("segments"),
            F.get("c", F.lit(0))["first"].alias("first"),
            F.element_at("c", -1)["last"].alias("last"),
            (F.forall("c", lambda x: x["steps_ok"]) & F.forall(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda a, b: step_ok(a["last"], b["first"], t)), lambda x: x)).alias("inner"),
        )
    )
    return one.unionByName(done(many, F.col("inner")))


def turns_read(formatted: Column, t: Template = INSTRUCT) -> Column:
    """Parse a formatted text back to array<struct<role, text>>."""
    quote = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    spans = [(x.opens, x.closes) for x in t.turns.values()]
    other = f"{quote(t.other[0])}.*?{quote(t.other[1])}"
    turn = "(?s)(" + "|".join([*(quote(o) for o, _ in spans), other]) + ")(.*?)(?:" + "|".join(quote(c) for c in [*(c for _, c in spans), t.other[2]]) + ")"
    opens, texts = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(k)) for k in (1, 2))

    def one(o: Column, x: Column) -> Column:
        generic = unescaped(F.substring(o, len(t.other[0]) + 1, F.length(o) - len(t.other[0]) - len(t.other[1])), t)
        role = reduce(lambda y, r: y.when(o == t.turns[r].opens, F.lit(r)), t.turns, F.when(F.lit(False), generic)).otherwise(generic)
        return F.struct(role.alias("role"), unescaped(x, t).alias("text"))

    return F.zip_with(opens, texts, one)


def digests(formatted: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """What is read back from the formatted text and from the loss mask."""
    read = formatted.select("conv_id", "formatted", "valid", turns_read(F.col("formatted"), t).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)).alias("loss"))
    read = read.withColumn("loss", F.array_join("loss", ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select -1L as conv_id, explode(array(struct(0L as turn, 'user' as role), struct(1L as turn, 'assistant' as role))) as t, '{PROBE}' as text").select("conv_id", "t.turn", "t.role", "text")
    return digests(format_chats(rows.unionByName(probe)))


def oracle() -> str:
    t = INSTRUCT
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = lambda x: reduce(lambda y, c: f"replace({y}, {q(c)}, {q(c[0] + t.escape + c[1:])})", t.controls(), f"replace({x}, {q(t.escape)}, {q(t.escape * 2)})")
    opens = "case role " + " ".join(f"when {q(r)} then {q(x.opens)}" for r, x in t.turns.items()) + f" else {q(t.other[0])} || {esc('role')} || {q(t.other[1])} end"
    closes = "case role " + " ".join(f"when {q(r)} then {q(x.closes)}" for r, x in t.turns.items()) + f" else {q(t.other[2])} end"
    steps = " or ".join(f"(state = {q(s)} and role in ({', '.join(map(q, to))}))" for s, to in t.steps.items())
    return f"""
    with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', {q(PROBE)} union all select -1, 1, 'assistant', {q(PROBE)}),
    seq as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
      lag(role, 1, '') over (partition by conv_id order by turn nulls first, role, text) as state,
      lead(role) over (partition by conv_id order by turn nulls first, role, text) as next from rows)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
      sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
      sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
      sum(length({opens}) + length({esc('text')}) + length({closes}))::bigint as formatted_chars,
      bool_and(({steps}) and (next is not null or role in ({', '.join(map(q, t.final))}))) as valid
    from seq group by conv_id"""

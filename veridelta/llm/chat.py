r"""Chat formatting with a grammar round trip (DataFrame functions only).

conversation = turn* ; turn = "<s>" role "[INST" level "]" body "[/INST]</s>" ; level = "" | ":1" | ":2" ; bodies and
roles hold no control string. A body is first written as it is. A deterministic parser reads the turn back. If role and text differ from the source,
control strings in the body are escaped (level 1), and if they still differ, all characters that could begin one and the
escape character itself (level 2), which always reads back. Roles are always escaped fully. The whole conversation is
parsed and compared as well, with level 2 for all its turns as the way out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of

TURN = r"(?s)^<s>([^\[]*)\[INST(:[12])?\](.*)$"
CLOSE, CLOSE_PATTERN = "[/INST]</s>", r"\[/INST\]</s>"
CONTROL, MARKED = r"(<|\[)(/?s>|/?INST[\]:])", r"(<|\[)~(/?s>|/?INST[\]:])"


def escape_all(c: Column) -> Column:
    for raw, code in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape_all(c: Column) -> Column:
    for raw, code in (("<", "~1"), ("[", "~2"), ("~", "~0")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def render(role: Column, text: Column, level: int) -> Column:
    """A turn. Level 1 puts a tilde after the first character of each control string."""
    body = (text, F.regexp_replace(text, CONTROL, "$1~$2"), escape_all(text))[level]
    return F.concat(F.lit("<s>"), escape_all(role), F.lit(f"[INST:{level}]" if level else "[INST]"), body, F.lit(CLOSE))


def unescape(level: Column, raw: Column) -> Column:
    """A body as it was before it was written at this level."""
    return F.when(level == "", raw).when(level == ":1", F.regexp_replace(raw, MARKED, "$1$2")).otherwise(unescape_all(raw))


def parse_turn(piece: Column) -> Column:
    """role and text of what stands before a closing mark; null where it isn't a turn."""
    raw = F.regexp_extract(piece, TURN, 3)
    text = unescape(F.regexp_extract(piece, TURN, 2), raw)
    return F.when(piece.rlike(TURN) & ~raw.rlike(CONTROL), F.struct(unescape_all(F.regexp_extract(piece, TURN, 1)).alias("role"), text.alias("text")))


def pieces(formatted: Column) -> Column:
    parts = F.split(formatted, CLOSE_PATTERN, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order, unescaped."""
    return F.transform(pieces(formatted), parse_turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (read back: array<struct<role,text>>), loss_runs.

    loss_runs has for each turn the code points to skip and then to take; `take` is the length of an assistant's body as
    it is written, and 0 for other roles. After the last run the rest is skipped.

    Turns are put in order of turn (null first), then role and text, so equal numbers have a defined order and repeated
    rows stay. Null texts and roles are empty. Rows with a null conv_id form one conversation. An empty table gives no
    conversations. Other columns are ignored. A conversation is one row of the result, so its turns meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), text_of("text")
    src = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    same = lambda got: (F.size(got) == 1) & (got[0] == F.struct("role", "text"))
    tried = src.select("*", *[render(F.col("role"), F.col("text"), k).alias(f"t{k}") for k in (0, 1)])
    tried = tried.select("conv_id", "turn", "role", "text", F.when(same(parse(F.col("t0"))), F.col("t0")).when(same(parse(F.col("t1"))), F.col("t1")).otherwise(render(F.col("role"), F.col("text"), 2)).alias("written"))
    whole = tried.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "written"))).alias("t"))
    whole = whole.select("conv_id", "t", F.array_join(F.transform("t", lambda x: x["written"]), "").alias("first"))
    whole = whole.select("conv_id", "t", "first", parse(F.col("first")).alias("back"))
    good = F.col("back") == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    safe = F.array_join(F.transform("t", lambda x: render(x["role"], x["text"], 2)), "")
    out = whole.select("conv_id", F.when(F.coalesce(good, F.lit(False)), F.col("first")).otherwise(safe).alias("formatted"))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), pieces(F.col("formatted")).alias("p"))

    def run(p: Column, i: Column) -> Column:
        body = F.char_length(F.regexp_extract(p, TURN, 3))
        head = F.char_length(p) - body + F.when(i > 0, len(CLOSE)).otherwise(0)
        loss = F.get("turns", i)["role"] == "assistant"
        return F.struct(F.when(loss, head).otherwise(head + body).alias("skip"), F.when(loss, body).otherwise(0).alias("take"))

    return out.select("conv_id", "formatted", "turns", F.transform("p", run).alias("loss_runs"))


def masked(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask: each run cut out of what is written, and unescaped by the level of its own turn.

    The level is what the skipped part ends with. Empty runs give empty texts.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, run: Column) -> Column:
        head, body = F.substring(formatted, acc["at"] + 1, run["skip"]), F.substring(formatted, acc["at"] + run["skip"] + 1, run["take"])
        text = F.when(run["take"] > 0, unescape(F.regexp_extract(head, r"\[INST(:[12])?\]$", 1), body)).otherwise("")
        return F.struct((acc["at"] + run["skip"] + run["take"]).alias("at"), F.concat(acc["out"], F.array(text)).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what format_chats read back; those of the loss are of the text under its mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = settled(F.array_join(masked(F.col("formatted"), F.col("loss_runs")), ""))
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

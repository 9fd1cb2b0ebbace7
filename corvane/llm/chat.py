"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is its number of leading ``>`` marks. Lines of one level that follow each other
are a passage; a message's passages of level 1 and deeper are its quotes, those of level 0 are its own
words. Passages are normalised (marks off, ASCII lower case, white space collapsed) and hashed, as
are each message's own passages, their paragraphs and their lines; a quote is linked to the message that wrote it: the latest
one before the quoter in its own conversation, or else the first one anywhere that lies before the
quoter in (conversation, turn) order. A message answers the message its first linked quote came
from, or else the turn before it. Conversations that quote each other form one thread; since every
parent lies before its child, (conversation, turn) order inside a thread is a reply order.

Each digest is reduced to one source per conversation, and to one overall, before any join, so a
line that everyone writes joins one row a conversation; digests that many quotes ask for are looked up by
broadcast. Running maxima and positions are taken in two levels, inside spans of turns (or of
conversations) and over the spans, so a very long conversation or thread fills no task.

Defined results: a null text is an empty message without quotes; a quote that nobody wrote is
dropped from the text and counts as unlinked; messages of a null conversation or turn are linked to
nothing, and have no thread and no position; repeated rows of a turn keep a row each, in order of their text; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, table
from .components import components

SPAN = 1024
#: Lines of quote marks: any number of ``>``, with white space before each and one space after the last; a fixed pattern.
MARKS = r"^((?:[ \t]*>)*)"


def normalise(text):
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "), "^ | $", "")


def digest(text):
    """SHA-256 of the normalised text; equal digests are taken for equal passages."""
    return F.unhex(F.sha2(normalise(text), 256))


def _before(df: DataFrame, group: list[str], at: str, value, out: str) -> DataFrame:
    """df with out: the largest value among the rows of the group whose at is smaller, in spans of at, so that no group fills a task."""
    df = df.withColumn("_s", F.floor(F.col(at) / SPAN)).withColumn("_x", value)
    inside = F.max("_x").over(Window.partitionBy(*group, "_s").orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    per = df.groupBy(*group, "_s").agg(F.max("_x").alias("_m"))
    along = F.max("_m").over(Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*group, "_s", along.alias("_p"))
    return df.withColumn("_i", inside).join(per, [*group, "_s"]).withColumn(out, F.coalesce("_i", "_p")).drop("_s", "_x", "_i", "_p")


def passages(text):
    """Array of (level, text) of runs of lines with one quote level."""
    lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[ \t]", "")).alias("level"), x.alias("line")))
    bare = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), F.when(x["level"] > 0, F.regexp_replace(x["line"], r"^(?:[ \t]*>)+[ ]?", "")).otherwise(x["line"]).alias("line")))
    begins = F.filter(F.transform(bare, lambda x, i: F.when((i == 0) | (x["level"] != F.get(bare, i - 1)["level"]), i)), lambda i: i.isNotNull())

    def block(i, k):
        end = F.coalesce(F.get(begins, k + 1), F.size(bare))
        part = F.slice(bare, i + 1, end - i)
        return F.struct(part[0]["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("text"))

    return F.transform(begins, block)


def link(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per message: conv_id, turn, role, thread_id, position, parent_conv, parent_turn, quote_level, n_quotes, n_linked, own_text."""
    base = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # texts without a mark have one passage, themselves
    split = base.withColumn("parts", F.when(F.instr("text", ">") > 0, passages(F.col("text"))).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("text")))))
    quotes = F.filter("parts", lambda p: (p["level"] > 0) & (F.length(normalise(p["text"])) > 0))
    own = F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    own = F.when(F.size("parts") > 1, F.regexp_replace(own, r"^[\r\n]+|[\r\n]+$", "")).otherwise(F.when(F.get("parts", F.lit(0))["level"] > 0, F.lit("")).otherwise(F.col("text")))
    rows = split.select(
        "conv_id", "turn", "role", own.alias("own_text"),
        F.transform(quotes, lambda p: F.struct(p["level"].alias("level"), digest(p["text"]).alias("h"))).alias("quotes"),
        F.filter("parts", lambda p: p["level"] == 0)["text"].alias("own"),
    )
    every = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "chat-rows")
    rows = every.where("conv_id is not null and turn is not null")
    asked = materialize(rows.select("uid", "conv_id", "turn", F.posexplode("quotes").alias("k", "q")).select("uid", "conv_id", "turn", "k", "q.h"), "chat-asked")
    wanted = asked.select("h").distinct()
    texts = F.array_distinct(F.flatten(F.transform("own", lambda p: F.concat(F.array(p), F.split(p, r"\n[ \t\r]*\n"), F.split(p, "\r\n|\n|\r")))))
    wrote = rows.select("conv_id", "turn", F.explode(F.concat(texts, F.array("own_text"))).alias("x")).select("conv_id", "turn", digest(F.col("x")).alias("h")).distinct()
    wrote = materialize(wrote.join(wanted, "h", "left_semi"), "chat-wrote")
    first = materialize(wrote.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first")), "chat-first")
    # in the quoter's own conversation: the latest writer before it, by a running maximum over writers and quoters
    events = wrote.select("conv_id", "h", "turn", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("k"))
    events = events.unionByName(asked.select("conv_id", "h", "turn", "uid", "k"))
    near = materialize(_before(events, ["conv_id", "h"], "turn", F.when(F.col("uid").isNull(), F.col("turn")), "near").where("uid is not null"), "chat-near")
    found = lookup(near, first, "h")
    there = F.struct("conv_id", "turn")
    source = F.when(F.col("near").isNotNull(), F.struct(F.col("conv_id").alias("conv_id"), F.col("near").alias("turn"))).when(F.col("first") < there, F.col("first"))
    found = found.select("uid", "k", source.alias("source"))
    linked = found.groupBy("uid").agg(F.count("source").alias("n_linked"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("k"))).alias("source"))
    out = rows.drop("own").join(linked, "uid", "left")
    out = _before(out, ["conv_id"], "turn", F.col("turn"), "before")
    parent = F.coalesce("source", F.when(F.col("before").isNotNull(), F.struct(F.col("conv_id").alias("conv_id"), F.col("before").alias("turn"))))
    out = materialize(out.select("uid", "conv_id", "turn", "source", parent.alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "own_text", "role", "quotes", F.floor(F.col("turn") / SPAN).alias("span")), "chat-linked")
    # positions: ranks inside spans of turns, on top of the rows of the spans and conversations before
    across = out.where("source.conv_id <> conv_id").select(F.col("conv_id").alias("a"), F.col("source.conv_id").alias("b"))
    threads = components(across, "a", "b")
    per = materialize(out.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n")), "chat-spans")
    along = per.select("conv_id", "span", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("n")).alias("ahead"))
    sizes = per.groupBy("conv_id").agg(F.sum("n").alias("n")).join(threads, F.col("conv_id") == F.col("node"), "left").select("conv_id", F.coalesce("component", "conv_id").alias("thread_id"), "n").withColumn("block", F.floor(F.col("conv_id") / SPAN))
    blocks = sizes.groupBy("thread_id", "block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("thread_id", "block", (F.sum("m").over(Window.partitionBy("thread_id").orderBy("block")) - F.col("m")).alias("below"))
    inner = F.sum("n").over(Window.partitionBy("thread_id", "block").orderBy("conv_id")) - F.col("n")
    base = sizes.withColumn("inner", inner).join(blocks, ["thread_id", "block"]).select("conv_id", "thread_id", (F.col("inner") + F.col("below")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "own_text", "uid")) - 1
    out = out.withColumn("r", rank).join(along.join(base, "conv_id"), ["conv_id", "span"])
    level = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("int").alias("quote_level")
    n_quotes = F.size("quotes").cast("long").alias("n_quotes")
    placed = out.select(
        "conv_id", "turn", "role", "thread_id", (F.col("r") + F.col("ahead") + F.col("base")).cast("long").alias("position"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), level, n_quotes, F.col("n_linked").cast("long").alias("n_linked"), "own_text",
    )
    none = F.lit(None).cast("long")
    alone = every.where("conv_id is null or turn is null").select("conv_id", "turn", "role", none.alias("thread_id"), none.alias("position"), none.alias("parent_conv"), none.alias("parent_turn"), level, n_quotes, F.lit(0).cast("long").alias("n_linked"), "own_text")
    return placed.unionByName(alone)


def op6_chat(spark, sf_dir) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


#: Quotes are parsed by lines here, linked by a join on whole normalised texts, and threads found by recursion.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS uid FROM conversations
), l AS (
  SELECT uid, i, regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[ \t]', '', 'g') AS marks, line
  FROM (SELECT uid, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT uid, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM m))
), b AS (
  SELECT uid, i, length(marks) AS level, CASE WHEN marks = '' THEN line ELSE regexp_replace(line, '^(?:[ \t]*>)+[ ]?', '') END AS line,
         CASE WHEN length(marks) IS DISTINCT FROM lag(length(marks)) OVER (PARTITION BY uid ORDER BY i) THEN 1 ELSE 0 END AS new FROM l
), g AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY i) AS part FROM b),
p AS (SELECT uid, part, min(level) AS level, string_agg(line, chr(10) ORDER BY i) AS text FROM g GROUP BY uid, part),
o AS (SELECT uid, string_agg(text, chr(10) ORDER BY part) FILTER (WHERE level = 0) AS own, count(*) AS n FROM p GROUP BY uid),
own AS (
  SELECT m.uid, conv_id, turn, role, CASE WHEN n = 1 AND own IS NOT NULL THEN text ELSE regexp_replace(coalesce(own, ''), '^[\r\n]+|[\r\n]+$', '', 'g') END AS own_text
  FROM m JOIN o USING (uid)
), x AS (
  SELECT uid, text AS t FROM p WHERE level = 0
  UNION ALL SELECT uid, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM p WHERE level = 0
  UNION ALL SELECT uid, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) FROM p WHERE level = 0
  UNION ALL SELECT uid, own_text FROM own
), w AS (
  SELECT DISTINCT conv_id, turn, regexp_replace(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS h
  FROM x JOIN m USING (uid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), q AS (
  SELECT * FROM (SELECT uid, conv_id, turn, part, level, regexp_replace(regexp_replace(translate(p.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS h
  FROM p JOIN m USING (uid) WHERE level > 0) WHERE h <> ''
), near AS (SELECT q.uid, q.part, max(w.turn) AS turn FROM q JOIN w ON q.h = w.h AND q.conv_id = w.conv_id AND w.turn < q.turn GROUP BY 1, 2),
far AS (SELECT h, conv_id AS fc, turn AS ft FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY conv_id, turn) = 1),
f AS (
  SELECT q.uid, q.part, CASE WHEN near.turn IS NOT NULL THEN q.conv_id WHEN (fc, ft) < (q.conv_id, q.turn) THEN fc END AS sc,
         CASE WHEN near.turn IS NOT NULL THEN near.turn WHEN (fc, ft) < (q.conv_id, q.turn) THEN ft END AS st
  FROM q LEFT JOIN near ON near.uid = q.uid AND near.part = q.part LEFT JOIN far ON far.h = q.h WHERE q.conv_id IS NOT NULL AND q.turn IS NOT NULL
), k AS (SELECT uid, count(sc) AS n_linked, arg_min(sc, part) FILTER (WHERE sc IS NOT NULL) AS sc, arg_min(st, part) FILTER (WHERE sc IS NOT NULL) AS st FROM f GROUP BY uid),
n AS (SELECT uid, count(*) AS n_quotes, max(level) AS quote_level FROM q GROUP BY uid),
e AS (SELECT DISTINCT conv_id AS a, sc AS b FROM k JOIN m USING (uid) WHERE sc <> conv_id),
c AS (SELECT a AS node, b AS root FROM e UNION SELECT b, a FROM e UNION SELECT c.node, y.root FROM c JOIN (SELECT a AS node, b AS root FROM e UNION SELECT b, a FROM e) y ON c.root = y.node),
th AS (SELECT node, least(node, min(root)) AS thread_id FROM c GROUP BY node),
r AS (
  SELECT uid, own.conv_id, turn, role, own_text, coalesce(thread_id, own.conv_id) AS thread_id FROM own LEFT JOIN th ON node = own.conv_id WHERE own.conv_id IS NOT NULL AND turn IS NOT NULL
)
SELECT r.conv_id, r.turn, r.role, r.thread_id, row_number() OVER (PARTITION BY r.thread_id ORDER BY r.conv_id, r.turn, r.own_text) - 1 AS position,
       coalesce(sc, CASE WHEN max(r.turn) OVER t IS NOT NULL THEN r.conv_id END) AS parent_conv, coalesce(st, max(r.turn) OVER t) AS parent_turn,
       CAST(coalesce(quote_level, 0) AS INT) AS quote_level, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, own_text
FROM r LEFT JOIN k ON k.uid = r.uid LEFT JOIN n ON n.uid = r.uid
WINDOW t AS (PARTITION BY r.conv_id ORDER BY r.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
UNION ALL
SELECT conv_id, turn, role, NULL, NULL, NULL, NULL, CAST(coalesce(quote_level, 0) AS INT), coalesce(n_quotes, 0), 0, own_text FROM own LEFT JOIN n USING (uid) WHERE conv_id IS NULL OR turn IS NULL
"""

r"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar: a conversation is turns; a turn is `### Name: body</turn>\n`, Name being User, Assistant, System or `=` and the
url-encoded role. Control strings inside texts are escaped by a backslash within them, one more if there are some
already: `</turn>` becomes `<\/turn>`, `<\/turn>` becomes `<\\/turn>`, `###` becomes `#\##` (each mark that two more follow
gets one). An escaped body holds no control string, so the parser is one split at `</turn>\n`, and undoing takes one
backslash away.

Rendering starts with no text escaped. The rendered text is parsed again, and a piece whose recovered turns differ from
its source is rendered once more with its texts escaped; then it parses to the same turns (column `identical`).

A conversation is rendered in pieces of 256 turn numbers, so that a very long one is spread over tasks; only the
finished strings of its pieces meet.

Defined cases: null text or role counts as empty; a null conv_id is a conversation of its own; null turns come first;
repeated turns are all kept, ordered by turn, role, text; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 256
END = "</turn>\n"
#: Control strings, with the backslashes that an escape has put in.
CONTROL = "</turn>|###"
ESCAPE = [(r"<(\\*)/turn>", r"<\\$1/turn>"), (r"#(\\*)(?=#\\*#)", r"#\\$1")]
UNESCAPE = [(r"<\\(\\*)/turn>", r"<$1/turn>"), (r"#\\(\\*)(?=#\\*#)", r"#$1")]


def escaped(text: Column) -> Column:
    for pattern, to in ESCAPE:
        text = F.regexp_replace(text, pattern, to)
    return text


def unescaped(text: Column) -> Column:
    for pattern, to in UNESCAPE:
        text = F.regexp_replace(text, pattern, to)
    return text


def header(role: Column) -> Column:
    named = F.when(role.isin("user", "assistant", "system"), F.initcap(role)).otherwise(F.concat(F.lit("="), F.url_encode(role)))
    return F.concat(F.lit("### "), named, F.lit(": "))


def render(turns: Column, escape: bool) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), escaped(t["text"]) if escape else t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text. Deterministic: split at the end marks, then at the first ': ' of each turn.

    A control string within a body is a fault of the grammar; the text of such a turn is null.
    """

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ": ")
        name = F.substring(piece, F.lit(5), cut - 5)
        role = F.when(F.substring(name, 1, 1) == "=", F.try_url_decode(F.substring(name, F.lit(2), F.length(name)))).otherwise(F.lower(name))
        body = F.substring(piece, cut + 2, F.length(piece))
        return F.struct(role.alias("role"), F.when(~body.rlike(CONTROL), unescaped(body)).alias("text"))

    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted (string), turns (array of role, text; as parsed from formatted), identical. rows: conv_id, turn, role, text."""
    own = rows.select("conv_id", F.floor(F.col("turn") / PIECE).alias("piece"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    pieces = own.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = pieces.select("conv_id", "piece", source.alias("source")).withColumn("formatted", render(F.col("source"), False))
    # Escape where the parser does not give back the source.
    second = first.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(render(F.col("source"), True)))
    checked = second.withColumn("turns", parse(F.col("formatted"))).withColumn("identical", F.col("turns") == F.col("source"))
    whole = checked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "formatted", "turns"))).alias("p"), F.every("identical").alias("identical"))
    return whole.select("conv_id", F.array_join(F.col("p.formatted"), "").alias("formatted"), F.flatten(F.col("p.turns")).alias("turns"), "identical")


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: those of the assistant's turns."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_conversations(rows.unionByName(extra))
    loss = F.array_join(loss_texts(F.col("turns")), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
h AS (
  SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(text, '\\+#', '#', 'g'), '#+'), lambda x: greatest(len(x) - 2, 0))), 0) AS hashes FROM r),
f AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length(text) + len(regexp_extract_all(text, '<\\*/turn>')) + hashes AS escaped,
         length(text) AS plain,
         14 + CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + length(url_encode(role)) END AS marks,
         regexp_matches(text, '<\\*/turn>') OR hashes > 0 AS conflict
  FROM h),
p AS (
  SELECT conv_id, turn // 256 AS piece,
         bool_or(conflict) AS again,
         sum(marks) AS marks, sum(escaped) AS escaped, sum(plain) AS plain FROM f GROUP BY ALL),
c AS (SELECT conv_id, sum(marks + CASE WHEN again THEN escaped ELSE plain END) AS formatted_chars FROM p GROUP BY conv_id)
SELECT f.conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       any_value(c.formatted_chars)::BIGINT AS formatted_chars
FROM f JOIN c USING (conv_id) GROUP BY f.conv_id
"""

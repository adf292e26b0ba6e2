"""Chat formatting by prefix-target expansion: one example for every assistant turn.

An example holds all turns before the reply as context and then the reply; only the reply is trainable. A conversation
that does not end with an assistant turn also gets one context-only record (no trainable text), so every turn can be
read back from the output. DataFrame functions only.

A turn is written as ``<|role|>`` newline text ``<|end|>`` newline. Inside texts and roles a backslash is doubled and
every control opening (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its first character,
which ``unescaped`` takes back exactly.

Turns are ordered by turn, role and text; NULL turns come first, NULL roles and texts count as empty, repeated rows
stay as turns of their own. A NULL conv_id is one conversation. Columns other than the four named ones are not
carried along. An example is one string by definition, so a conversation must fit into one row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import query, table

# Openings of control strings of this and of common templates.
OPENINGS = r"<(?=\||s>|/s>)|\[(?=/?INST\])"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), OPENINGS, r"$0\\")


def escaped_role(role: Column) -> Column:
    doubled = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(doubled, OPENINGS, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              target: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (0, 1, ...), formatted, loss_start and loss_end (code points, end exclusive)."""
    empty = F.lit("")
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), empty).alias("role"),
                 F.coalesce(F.col(f"`{text}`"), empty).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == target).alias("target"),
        F.concat(F.lit("<|"), escaped_role(t["role"]), F.lit("|>\n")).alias("head"),
        escaped(t["text"]).alias("body"),
    )).alias("parts"))
    written = parts.select(
        "conv_id", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))).alias("written"))
    each = written.select("conv_id", "written", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "p"))
    last = F.col("k") == F.col("n") - 1
    chosen = each.where(F.col("p.target") | last)
    context = F.array_join(F.slice("written", F.lit(1), F.col("k")), "")
    built = chosen.select(
        "conv_id", F.col("k").alias("turn_no"), "p", context.alias("context"), F.element_at("written", F.col("k") + 1).alias("own"))
    start = F.length("context") + F.length("p.head")
    return built.select(
        "conv_id", F.col("turn_no").alias("example"), F.concat("context", "own").alias("formatted"),
        F.when(F.col("p.target"), start).alias("loss_start"),
        F.when(F.col("p.target"), start + F.length("p.body")).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its examples alone."""
    reply = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    seen = examples.select(
        "conv_id", "example", "formatted", F.when(F.col("loss_start").isNotNull(), reply).alias("reply"))
    per = seen.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    # the last piece is what follows the last end mark: nothing
    pieces = F.filter(F.split("longest", r"<\|end\|>\n"), lambda p: p != "")
    head = r"(?s)^<\|((?:[^|\\]|\\.)*)\|>\n(.*)$"
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")))
    parsed = per.select("conv_id", "formatted_chars", turns.alias("turns"),
                        F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, 13 + length(role) + length(text)
      + length(text) - length(replace(text, '\', ''))
      + length(regexp_replace(text, '<\||<s>|</s>|\[/?INST\]', '\0!', 'g')) - length(text) AS chars
  FROM rows),
numbered AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM written
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id
"""


@query("op5_chat_format", ORACLE)
def op5(spark, sf_dir):
    """Every conversation expanded into its examples and read back from them; conversation -7 speaks in control strings."""
    spoken = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(spoken).alias("text"))
    return read_back(formatted(rows.unionByName(extra)))

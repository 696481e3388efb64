"""Registered queries of the corpus operators: thin layers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm import bpe, chat, decontaminate, linededup, outliers, pii, quality, repair, repeats, runs, sharding, simhash, toxicity
from netvigil.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _held_out_scores(scores: DataFrame, parts: int, held: int, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold(parts) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return _held_out_scores(scores, 5, 0, quality.THRESHOLD)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2)
    return _held_out_scores(scores, 4, 2, toxicity.THRESHOLD)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)],
                                  "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(probe)).withColumn("turns", chat.parse(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), told.alias("told"),
                     chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "round_trip")
    return out.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")


def word_bpe() -> str:
    """Definition of the public word tokenizer that the box offers."""
    import public_tokenizers

    return bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), word_bpe())


_ESCAPED = r"""regexp_replace({0}, '([\[<])(\\*)(/?(?:INST|SYS|ROLE|TURN)\]|/?s>)', '\1\\\2\3', 'g')"""

ORACLES["op6_chat"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
    SELECT *, length({_ESCAPED.format('text')})
              + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 7
                ELSE 25 + length({_ESCAPED.format('role')}) END AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::bigint AS formatted_chars, true AS round_trip
FROM marked GROUP BY conv_id
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.assign(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


# The checksum table follows from the polynomial 0xEDB88320, eight shifts for each byte.
_CRC_TABLE = """steps(i, k, v) AS (
    SELECT i, 0, i::bigint FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
bytes AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint),
                           lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295)"""


ORACLES["op7_sharding"] = f"""
WITH RECURSIVE {_CRC_TABLE},
sized AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
           {_crc32_sql("coalesce(text, '')")} AS text_crc32,
           coalesce('=' || source, 'null') AS stratum, md5('42:' || coalesce(doc_id::varchar, '')) AS draw
    FROM documents, bytes),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) AS place,
           count(*) OVER (PARTITION BY stratum) AS members FROM sized),
ordered AS (
    SELECT *, row_number() OVER (ORDER BY (place - 0.5::double) / members::double, stratum, draw, doc_id NULLS FIRST, text_crc32, size) - 1 AS spot,
           count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (spot * 40 // total)::int AS shard,
       spot - (spot * 40 // total * total + 39) // 40 AS slot, NULL::int AS grown_shard
FROM ordered
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "distance")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats_digest(table(spark, sf_dir, "documents"))


@query
def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_STRIPPED = " || ".join(f"chr({code})" for code in (32, 9, 10, 11, 12, 13))

ORACLES["op12_linededup"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT row_no, i, lines[i] AS line,
           translate(trim(lines[i], {_STRIPPED}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM docs, unnest(range(1, len(lines) + 1)) t(i)),
common AS (SELECT key AS found FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10),
parts AS (
    SELECT row_no, count(*) AS n_lines, count(found) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (found IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN common ON key = found GROUP BY row_no)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM docs JOIN parts USING (row_no)
"""


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(table(spark, sf_dir, "documents"), runs.planted)
    lines = F.transform("runs", lambda r: F.concat(F.array_join(r.cast("array<string>"), ","), F.lit("\n")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    audits, repaired = repair.repair(repair.damaged(rows))
    every, shas = rows.select(F.col("conv_id").cast("long")).distinct(), repair.digests(repaired)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(audits, every["conv_id"].eqNullSafe(audits["conv_id"]), "left").join(
        shas, every["conv_id"].eqNullSafe(shas["conv_id"]), "left").select(
        every["conv_id"], *[F.coalesce(audits[c], F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_BLANK_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _cells(cells: dict[str, list[str]]) -> str:
    """Each cell is the least of its options as (cost, audit), cost first, then the audit in ASCII order."""
    return ", ".join(f"list_min([{', '.join(options)}]) AS {name}" for name, options in cells.items())


def _moved(cell: str, cost: str, letter: str) -> str:
    return f"{{'cost': {cell}.cost + {cost}, 'audit': {cell}.audit || '{letter}'}}"


def _only(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN {option} ELSE {{'cost': 1000000000000, 'audit': ''}} END"


_FAR = "{'cost': 1000000000000, 'audit': ''}"
# k0 nothing yet, k1 after system, k2 after user, k3 after assistant; r2 and r3 after rows put in


def _put_in(source: str) -> str:
    two = _cells({"r2": ["k2", *(_moved(k, "5", "I") for k in ("k0", "k1", "k3"))]})
    return f"SELECT *, {_cells({'r3': ['k3', _moved('r2', '5', 'I')]})} FROM (SELECT *, {two} FROM {source})"


ORACLES["op11_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS name FROM conversations),
faulty AS (SELECT *, {_crc32_sql("name")} % 20 AS fault FROM raw, bytes),
kept AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM faulty, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) c(copy) WHERE fault <> 0),
placed AS (
    SELECT *, coalesce('=' || conv_id, '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           rtrim(text, {_BLANK_CHARS}) AS solid FROM kept),
flagged AS (
    SELECT *, length(solid) = 0 AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS repeated,
           right(solid, 1) NOT IN ('.', '!', '?') AS open, substr(role, 1, 1) AS x,
           lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
judged AS (SELECT *, blank OR repeated AS doomed, CASE WHEN open AND NOT blank AND NOT repeated THEN 5 ELSE 0 END AS w FROM flagged),
dp AS (
    SELECT DISTINCT c, 0::bigint AS i, {{'cost': 0::bigint, 'audit': ''}} AS k0, {_FAR} AS k1, {_FAR} AS k2, {_FAR} AS k3 FROM judged
    UNION ALL
    SELECT c, j_i, {_cells({
        "n0": [_moved("k0", "2", "D")],
        "n1": [_moved("k1", "2", "D"), _only("NOT doomed AND x = 's'", _moved("k0", "w", "K"))],
        "n2": [_moved("r2", "2", "D"), *(_only("NOT doomed AND x = 'u'", _moved(k, "w", "K")) for k in ("k0", "k1", "r3")),
               *(_only("NOT doomed", _moved(k, "w + 1", "R")) for k in ("k0", "k1", "r3"))],
        "n3": [_moved("r3", "2", "D"), _only("NOT doomed AND x = 'a'", _moved("r2", "w", "K")),
               _only("NOT doomed", _moved("r2", "w + 1", "R"))]})}
    FROM ({_put_in("(SELECT dp.*, j.i AS j_i, x, doomed, w FROM dp JOIN judged j ON j.c = dp.c AND j.i = dp.i + 1)")})),
ended AS (
    SELECT c, list_min([k0, r3]) AS best FROM ({_put_in("(SELECT * FROM dp WHERE (c, i) IN (SELECT c, max(i) FROM judged GROUP BY c))")})),
letters AS (
    SELECT c, e, best.audit[e] AS letter FROM ended, unnest(range(1, length(best.audit) + 1)) t(e)),
counted AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place
    FROM letters WINDOW w AS (PARTITION BY c ORDER BY e)),
left_in AS (
    SELECT n.*, j.role, j.text, max(CASE WHEN place = 1 AND letter = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.c) AS led
    FROM counted n LEFT JOIN judged j ON j.c = n.c AND j.i = n.i AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (
    SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                         || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS told
    FROM left_in GROUP BY c),
counts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (repeated AND NOT blank) AS duplicate, count(*) FILTER (w > 0) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::bigint AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS c FROM conversations)
LEFT JOIN counts USING (c) LEFT JOIN ended USING (c) LEFT JOIN repaired USING (c)
"""

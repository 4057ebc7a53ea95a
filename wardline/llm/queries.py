"""The registered query of each operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import chat_format, conversation_repair, embed_dedup, language_id, lm_score, ngram_join, pfair, pieces, prefix_trie, quality_bayes, quality_rules, token_binary, token_counts
from wardline.operators.same import join_same
from wardline.session import shared_dir

#: Target weights of the mixture, out of 1,000; all other sources share the rest.
WEIGHTS = {"src0": 150, "src1": 120, "src2": 100, "src3": 80, "src4": 70, "src5": 60, "src6": 50, "src7": 50, "src8": 40, "src9": 40}
REST = 1000 - sum(WEIGHTS.values())
END_ID = 2
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
WORDS_SIZE = 49_408
BYTES_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: The conversation whose texts are control strings.
CONTROL = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the mixture."""
    return pfair.mix(_table(spark, sf, "documents"), WEIGHTS, REST)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule figures and verdict per document; cutoffs per language."""
    return quality_rules.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of text, source and language per document."""
    return quality_bayes.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy difference to documents labelled good and not toxic."""
    labels = _table(spark, sf, "labels")
    return lm_score.score(_table(spark, sf, "documents"), labels.where("quality = 1 and toxic = 0"))


def op5_token_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Ids written in blocks and read back."""
    docs = _table(spark, sf, "documents")
    path = shared_dir(spark, "token-blocks")
    token_binary.write(docs, path, token_binary.word_tokenizer(WORDS_FILE), END_ID, WORDS_SIZE)
    return token_binary.read_index(spark, path, docs.schema["doc_id"].dataType)


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Component of each document under five-word shingles and a similarity of 0.8."""
    return ngram_join.jaccard_components(_table(spark, sf, "documents")).drop("keeper")


def op7_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of each vector at a cosine of 0.93."""
    return embed_dedup.near_copies(_table(spark, sf, "embeddings"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document; the held-out fold is never learned from."""
    docs = _table(spark, sf, "documents")
    model = language_id.train(docs.where((language_id.fold() != 2) & F.col("lang").isNotNull()))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(language_id.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text, and of one that holds control strings."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    turns = turns.unionByName(own)
    chats = chat_format.format_chats(turns)
    read = chat_format.parse_chats(chats)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the ids of each document, with round trip and parity."""
    return pieces.encode(_table(spark, sf, "documents"), PIECES_FILE).drop("ids")


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt so that they share first turns."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", prefix_trie.token_of("role", "text").alias("token"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the crc32 of their place: some go, others lose text or an end, come twice, or change their role."""
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    turns = turns.withColumn("_fault", F.crc32(named.cast("binary")) % 20)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_fault") == 4, "user").otherwise(role)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return turns.where("_fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    summary, edits = conversation_repair.repair(_damaged(turns))
    every = turns.select("conv_id").distinct()
    out = join_same(join_same(every, summary, ["conv_id"], "left"), conversation_repair.digests(edits), ["conv_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return token_counts.count_tokens(_table(spark, sf, "documents"), BYTES_FILE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pfair_mix, op2_quality_rules, op3_quality_classifier, op4_lm_scoring, op5_token_binary, op6_ngram_jaccard,
        op7_embedding_dedup, op8_language_id, op9_chat_format, op10_sentencepiece, op11_prefix_trie, op12_conversation_repair, op13_token_counts,
    )
}


def _chat_sql() -> str:
    """Digests straight from the turns; the length of the formatted text from the lengths of its parts."""
    t = chat_format.CHAT
    rests = "|".join("".join(f"\\{c}" if c in "[]/" else c for c in m[1:]) for m in t.controls)
    escaped = f"regexp_replace(replace(x.text, '\\', '\\\\'), '([<\\[])({rests})', '\\1~\\2', 'g')"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    other = f"{sum(map(len, t.other))} + length({escaped.replace('x.text', 'x.role')})"
    return f"""
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
), y AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length({escaped}) + CASE x.role {marks} ELSE {other} END) AS formatted_chars
  FROM x GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM y
"""


#: The links of op7 are all pairs, which SQL can compare within a label.
_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), false)
         AND coalesce(list_bool_or([x <> 0 FOR x IN embedding]), false) AS ok
  FROM embeddings
), u AS (SELECT vec_id, label, e FROM v WHERE ok),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

#: Sets, links and components of op6, by a join on the shingles themselves.
_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh
  FROM w
), r AS (SELECT min(doc_id) AS id, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
e AS (SELECT id, n, unnest(sh) AS g FROM r),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT id AS x, id AS y FROM r UNION SELECT q.x, b.y FROM reach q JOIN b ON q.y = b.x),
k AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.sh = list_sort(s.sh) LEFT JOIN k ON k.x = r.id
"""

def _crc_sql(text: str) -> str:
    """The crc32 of an ASCII text: bit by bit, as the polynomial 0xEDB88320 has it."""
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    codes = f"[ascii(substr({text}, i, 1))::BIGINT FOR i IN range(1, length({text}) + 1)]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {bits}))"


#: The trie of op11: nodes by their whole paths, and subtrees by the paths of each node's smallest member.
_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, k, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, __CRC__ % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, k, n FROM c JOIN o ON o.conv_id = base WHERE pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, k, n FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos > h
), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM r),
m AS (SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, n FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM m GROUP BY conv_id) GROUP BY path),
x AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM m GROUP BY path, d),
up AS (SELECT x.path, m.path AS above FROM x JOIN m ON m.conv_id = x.conv_id AND m.d = x.d - 1),
kids AS (SELECT above AS path, count(*) AS n_children FROM up GROUP BY above),
y AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN kids USING (path)),
sums AS (
  SELECT m.path, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.n) AS saved_tokens
  FROM y JOIN m ON m.conv_id = y.conv_id AND m.d <= y.d GROUP BY m.path
)
SELECT y.conv_id, y.d AS depth, p.conv_id AS parent_conv_id, y.n_convs, y.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM y JOIN sums USING (path) LEFT JOIN e USING (path) LEFT JOIN up USING (path) LEFT JOIN x p ON p.path = up.above
"""

#: The repair of op12 row by row: per conversation the best (cost, audit, text) of each state of the machine.
_REPAIR_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, __CRC__ % 20 AS f
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, range(CASE WHEN f = 3 THEN 2 ELSE 1 END) WHERE f <> 0
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
r AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER w AS bi,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), c AS (SELECT *, fault IS NULL OR fault = 'truncated' AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x FROM r),
n AS (SELECT DISTINCT conv_id FROM conversations),
s AS (
  SELECT conv_id, 0::BIGINT AS pos, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s1,
         {'c': 5::BIGINT, 'a': 'I', 't': ['user:']} AS s2, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s3
  FROM n
  UNION ALL
  SELECT conv_id, pos, s0, s1, s2, list_min([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': list_append(s2.t, 'assistant:')}]) AS s3 FROM (
    SELECT conv_id, pos, s0, s1, s3, list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I', 't': list_append(s0.t, 'user:')},
           {'c': s1.c + 5, 'a': s1.a || 'I', 't': list_append(s1.t, 'user:')}, {'c': s3.c + 5, 'a': s3.a || 'I', 't': list_append(s3.t, 'user:')}]) AS s2 FROM (
      SELECT s.conv_id, c.pos, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS s0,
        list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + x + CASE WHEN ok AND i = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, role || ':' || text)}]) AS s1,
        list_min(list_concat([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}],
          [{'c': q.c + x + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'a': q.a || 'R', 't': list_append(q.t, 'user:' || text)} FOR q IN [s0, s1, s3]],
          [{'c': q.c + x + CASE WHEN ok AND i = 'u' THEN 0 ELSE 1000000000 END, 'a': q.a || 'K', 't': list_append(q.t, role || ':' || text)} FOR q IN [s0, s1, s3]])) AS s2,
        list_min([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}, {'c': s2.c + x + CASE WHEN ok THEN 1 ELSE 1000000000 END, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)},
          {'c': s2.c + x + CASE WHEN ok AND i = 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K', 't': list_append(s2.t, role || ':' || text)}]) AS s3
      FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.pos = s.pos + 1
    )
  )
), b AS (SELECT conv_id, list_min([s0, s3]) AS z FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (bi IS NOT NULL AND bi || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, z.c AS cost, z.a AS audit, sha256(array_to_string(z.t, chr(10))) AS repaired_sha256
FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLES: dict[str, str] = {
    "op6_ngram_jaccard": _JACCARD_SQL,
    "op7_embedding_dedup": _EMBEDDING_SQL,
    "op9_chat_format": _chat_sql(),
    "op11_prefix_trie": _TRIE_SQL.replace("__CRC__", _crc_sql("s")),
    "op12_conversation_repair": _REPAIR_SQL.replace("__CRC__", _crc_sql("k")),
}

"""One query per training-data operator, over its whole table with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, chat, collocations, matroska, minhash, mixing, packing, secret_scan, substring_dedup, token_store, toxicity, vector_codes, weak_quality
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op1_repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a unit; ``op1_substring_dedup`` returns those in runs that are long enough."""
    return substring_dedup.later_occurrences(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.emissions(mixing.plan(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return token_store.token_digests(table(spark, sf_dir, "documents"), tokenizer_path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents")).drop("n_cp")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op1_repeated_sentences,
        op2_quality_classifier,
        op3_minhash_near_dedup,
        op4_chat_formatting,
        op5_source_mixing,
        op6_toxicity,
        op7_media_matroska,
        op8_token_output,
        op9_exact_dedup,
        op10_best_fit_packing,
        op11_secret_scan,
        op12_phrase_collocations,
        op13_vector_codes,
    )
}

#: Later occurrences of units. White space behind a sentence's mark becomes a line end of the same length; behind full-width
#: marks a line end is put in, marked by U+E000, which belongs to no text.
_LATER = r"""p AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([.!?,;:\x{2026}])[\x20\x09-\x0D]', E'\\1\n', 'g'), '([\x{3002}\x{FF01}\x{FF1F}\x{FF0C}\x{3001}\x{FF1B}\x{FF1A}]+)([^\x{3002}\x{FF01}\x{FF1F}\x{FF0C}\x{3001}\x{FF1B}\x{FF1A}\n])', '\1' || chr(57344) || chr(10) || '\2', 'g') AS x FROM documents),
l AS (SELECT doc_id, string_split(x, chr(10)) AS ls FROM p),
a AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM l),
z AS (SELECT doc_id, i, rtrim(line, chr(57344)) AS line, CASE WHEN ends_with(line, chr(57344)) THEN 0 ELSE 1 END AS gap FROM a),
o AS (SELECT doc_id, i, line, coalesce(sum(length(line) + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
        regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM z),
u AS (SELECT doc_id, s, s + length(line) AS e, len(w) AS words, array_to_string(w, ' ') AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit FROM o WHERE len(w) > 0),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first_doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id, unit) AS rn FROM u),
d AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM r WHERE rn > 1),
t AS (SELECT doc_id, unit::INT AS unit, s AS start_char, e AS end_char, words::BIGINT AS n_words, (sum(words) OVER (PARTITION BY doc_id, run))::BIGINT AS run_words, first_doc_id FROM d)"""



def _code_rounds(rounds: int = 4) -> str:
    """DuckDB SQL of the codebooks: a table of nearest entries and one of means by round; sums of integers in doubles are exact here."""
    near = "a{0} AS MATERIALIZED (SELECT id, part, min({{'d': d, 'e': e}}) AS b FROM (SELECT p.id, p.part, c.e, (list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM p JOIN c{0} c USING (part)) GROUP BY 1, 2)"
    mean = "c{1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (SELECT part, e, list(floor(s / n) ORDER BY j) AS x FROM (SELECT a.part, b.e AS e, j, sum(p.x[j]) AS s, count(*) AS n FROM a{0} a JOIN p USING (id, part), range(1, 17) r(j) GROUP BY ALL) GROUP BY 1, 2) m ON m.part = c.part AND m.e = c.e)"
    return ",\n".join(x.format(k, k + 1) for k in range(rounds) for x in (near, mean)) + ",\n" + near.format(rounds)


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"WITH {_LATER} SELECT * FROM t WHERE run_words >= 35",
    "op1_repeated_sentences": f"WITH {_LATER} SELECT *, run_words >= 35 AS removed FROM t",
    "op4_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS x FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(4 + length(role) + 2 + length(x) + 8) AS chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM g""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hot AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN hot USING (g)) a JOIN (SELECT * FROM s SEMI JOIN hot USING (g)) b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 6) a(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT s.lang, s.phrase FROM c s JOIN c l ON l.lang = s.lang AND l.k > s.k AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * l.a >= 100 * s.a),
t AS (SELECT c.*, string_split(phrase, ' ') AS w FROM c ANTI JOIN x USING (lang, phrase)),
u AS (SELECT t.lang, t.phrase, t.a, j, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * t.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM t, range(1, 5) b(j), n, f l, f r WHERE j < t.k AND n.lang = t.lang AND l.lang = t.lang AND l.k = j AND l.phrase = array_to_string(t.w[1:j], ' ') AND r.lang = t.lang AND r.k = t.k - j AND r.phrase = array_to_string(t.w[j + 1:], ' ')),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM m QUALIFY rank <= 2000""",
    "op13_vector_codes": f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, i AS part, v[16 * i + 1:16 * i + 16] AS x FROM k, range(4) r(i)),
c0 AS MATERIALIZED (SELECT part, id - 1 AS e, x FROM p WHERE id <= 256),
{_code_rounds()},
o AS (SELECT id, string_agg(printf('%02x', b.e), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, e, j)) AS s FROM (SELECT part, e, j, x[j] AS y FROM c4, range(1, 17) r(j)))
SELECT k.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.s AS codebooks_sha256 FROM k JOIN o USING (id), h""",
}

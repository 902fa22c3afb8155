"""The registered queries of this subpackage and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import bloom_lm, conversations, hamming, lang_id, line_dedup, mixing, near_dup, ngram_join, nra_search, pii, sentence_piece, url_filter, vp_tree

RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)
REMEMBERED = 500_000  # segments; a query that does nothing else has the memory
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPAM_NAMES = ("casino-win", "cheap-pills", "free-bets", "spam-farm")  # host names whose pages are listed


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text; a missing id reads as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    model = lang_id.fit(docs.filter(_remainder(F.col("doc_id"), 5) != 0))
    held_out = (_remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return lang_id.classify(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_load(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    others = [F.array_remove(kinds, k) for k in pii.KINDS[:4]]
    count = [(F.size("spans") - F.size(o)).cast("long").alias(f"n_{k}") for k, o in zip(pii.KINDS, others, strict=False)]
    base = pii.spelled(F.filter("spans", lambda s: s["kind"] != "term"))
    return found.select("doc_id", *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_load(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    model = bloom_lm.train(docs.filter(_remainder(F.col("doc_id"), 7) != 2))
    held_out = (_remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    scores = bloom_lm.score(docs, model)
    return scores.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(_load(spark, sf_dir, "embeddings"))
    return hamming.nearest_codes(codes, codes.filter(F.col("id") % 100 == 0))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vp_tree.usable_vectors(_load(spark, sf_dir, "embeddings"))
    return vp_tree.nearest_vectors(vectors, vectors.filter(F.col("id") % 20 == 0))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The block list: canonical URLs of all pages on hosts with a listed name as one of their labels."""
    host, path = url_filter.url_parts(F.col("url"))
    named = F.arrays_overlap(F.split("_host", r"\."), F.array(*map(F.lit, SPAM_NAMES)))
    pages = pages.select(host.alias("_host"), path.alias("_path")).filter(named)
    return pages.select(url_filter.canonical_url(F.col("_host"), F.col("_path")).alias("canonical"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _load(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages, listed_urls(pages), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_sentence_piece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    model = sentence_piece.read_model(model_path)
    return sentence_piece.encode(_load(spark, sf_dir, "documents"), model, remembered=REMEMBERED)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_load(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_search.search(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_line_dedup, op3_mixing, op4_personal_data, op5_near_duplicates, op6_lm_scores, op7_hamming_search, op8_vector_search, op9_url_filter, op10_sentence_piece, op11_ngram_join, op12_lexical_search, op13_conversation_repair)
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _edited(state: str, cost: str, letter: str, line: str) -> str:
    """A state's struct after one more edit, in SQL."""
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {state}.lines || {line}}}"


def _inserted(of: str) -> str:
    """The structs s0 to s3 of ``of`` after any inserts, in SQL: f2 and f3 are the least ways to the states 2 and 3."""
    two = ", ".join(_edited(f"{of}.s{q}", "2", "I", "['user:']") for q in (0, 1, 3))
    f2 = f"list_min([{of}.s2, {two}])"
    return f"SELECT *, list_min([s3, {_edited('f2', '2', 'I', "['assistant:']")}]) AS f3 FROM (SELECT *, {f2} AS f2 FROM {of})"


def _repair_step() -> str:
    """One row's edits on the structs of all states, in SQL."""
    states = ("s0", "s1", "f2", "f3")
    stays = {"s0": [], "s1": [], "f2": [], "f3": []}
    for state, initial, to in (("s0", "s", "s1"), ("s0", "u", "f2"), ("s1", "u", "f2"), ("f2", "a", "f3"), ("f3", "u", "f2")):
        price = f"(CASE WHEN fault < 2 AND left(role, 1) = '{initial}' THEN fault ELSE 1000000000 END)"
        stays[to].append(_edited(state, price, "K", "[role || ':' || text]"))
    for state, role, to in (("s0", "user", "f2"), ("s1", "user", "f2"), ("f2", "assistant", "f3"), ("f3", "user", "f2")):
        price = "(CASE WHEN fault < 2 THEN 2 + fault ELSE 1000000000 END)"
        stays[to].append(_edited(state, price, "R", f"['{role}:' || text]"))
    return ", ".join(f"list_min([{', '.join([_edited(s, '3', 'D', '[]'), *stays[s]])}]) AS s{q}" for q, s in enumerate(states))


_FAR_STATE = "{'cost': 1000000000::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
ORACLES = {
    "op13_conversation_repair": rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) t(i))
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), planted AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
                            lambda c, b: xor(crc[1 + xor(c & 255, b)], c >> 8)), 4294967295) % 20 AS fate FROM drawn, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS time
  FROM planted WHERE fate <> 0
), seen AS (
  SELECT *, right(rtrim(text, {_WHITE}), 1) AS ending,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM rows
), faults AS (
  SELECT *, CASE WHEN ending = '' THEN 3 WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 2
                 WHEN ending NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM seen
), states AS (
  SELECT DISTINCT conv_id, 1::BIGINT AS pos, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS s0, {_FAR_STATE} AS s1,
         {_FAR_STATE} AS s2, {_FAR_STATE} AS s3 FROM faults
  UNION ALL
  SELECT conv_id, pos + 1, {_repair_step()}
  FROM ({_inserted("states")}) JOIN faults USING (conv_id, pos)
), ended AS (
  SELECT conv_id, list_min([s0, f3]) AS best FROM ({_inserted("states")}) AS ended
  WHERE pos = (SELECT 1 + max(f.pos) FROM faults f WHERE f.conv_id = ended.conv_id)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)""",
    "op12_lexical_search": rf"""
WITH found AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS t FROM documents
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS length FROM found WHERE len(t) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark
), postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM found)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), whole GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50""",
    "op11_ngram_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)
), reached AS (
  SELECT doc_id AS start, doc_id AS y FROM documents UNION SELECT r.start, l.y FROM reached r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reached WHERE start = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_WHITE})")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), keys AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.first AS dropped FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('11-' || doc_id), 1, 10) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS total,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sizes GROUP BY source
), steps AS (
  SELECT *, 2 * total / weight AS full_at,
         (1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER before, 0)) / sum(weight) OVER after AS level
  FROM sources
  WINDOW before AS (ORDER BY 2 * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY 2 * total / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(arg_min(level, full_at) FILTER (level < full_at), 1e300) AS level FROM steps
), targets AS (
  SELECT source, total::BIGINT AS source_size, CASE WHEN 2 * total <= weight * level THEN 2 * total ELSE weight * level END AS target
  FROM sources, level
), placed AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
        + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END)::BIGINT AS taken
FROM placed""",
    "op7_hamming_search": """
WITH codes AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, 1 + len(q.embedding)),
                                 lambda i: ((q.embedding[i] > 0) <> (c.embedding[i] > 0))::INT))::BIGINT AS distance
  FROM codes q JOIN codes c ON len(q.embedding) = len(c.embedding) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10""",
    "op9_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE list_has_any(string_split(host, '.'), ['casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
), ruled AS (
  SELECT n.*, l.canonical IS NOT NULL AS hit,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named n LEFT JOIN listed l ON n.canonical = l.canonical
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)

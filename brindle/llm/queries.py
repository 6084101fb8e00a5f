"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import chat, collocations, context_tree, exact_dedup, filter_audit, html_extract, media, mixing, ngram_join, packing, substring_dedup, token_counts, toxicity
from brindle.llm.common import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, white space aside."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256, doc_id ORDER BY chars DESC) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND n = 1) AS kept, text_sha256 FROM g
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from four fifths of the labels."""
    return toxicity.scored_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation of control strings that every run of op2 formats besides the table's.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, rendered and masked, then read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = tokenizer_path("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(turns, path), path).drop("n_tokens", "n_loss_tokens")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), e AS (
  SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(chat.ROLE + chat.TEXT + chat.END)} AS chars FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(chars) AS BIGINT) + {len(chat.BOS)} AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller id has."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, i, array_to_string(words[i : i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), m AS (SELECT win, min(doc_id) AS owner FROM s GROUP BY win),
r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM s JOIN m USING (win) WHERE owner < doc_id
), g AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string([words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(coalesce(gone, []), k)], ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under context-tree weighting, and under word counts."""
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, low) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id WHERE e.y > r.low),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = w.doc_id
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for a mixture by the domains' target weights and damped sources, as many tokens as there are."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=DOMAIN_WEIGHTS)


#: What part of the mixture each domain is to have.
DOMAIN_WEIGHTS = {("d0",): 0.4, ("d1",): 0.3, ("d2",): 0.2, ("d3",): 0.1}


def _shares_sql(name: str, children: str, columns: str, parent: str, child: str) -> str:
    """The steps from children with a budget, weight and capacity to their shares by water level."""
    part = f"PARTITION BY {parent} " if parent else ""
    order = f"({part}ORDER BY ratio, {child} ROWS BETWEEN"
    return f"""{name}_ratio AS (SELECT *, capacity / weight AS ratio FROM ({children})),
{name}_level AS (SELECT *, row_number() OVER ({part}ORDER BY ratio, {child}) AS place,
  (budget - coalesce(sum(capacity) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_ratio),
{name}_first AS (SELECT *, min(CASE WHEN ratio > level THEN place END) OVER ({part}) AS short FROM {name}_level),
{name}_water AS (SELECT *, max(CASE WHEN place = short THEN level END) OVER ({part}) AS water FROM {name}_first),
{name} AS (SELECT {columns}, tokens, CASE WHEN water IS NULL OR ratio <= water THEN CAST(capacity AS DOUBLE) ELSE weight * water END AS share FROM {name}_water)"""


_TARGETS = " ".join(f"WHEN '{d}' THEN {w}" for (d,), w in DOMAIN_WEIGHTS.items())
_NODE = "pow(CAST(tokens AS DOUBLE), 0.7) AS weight, tokens * 4 AS capacity"
OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS doc_tokens, md5(coalesce(text, '')) AS text_md5 FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(doc_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL HAVING sum(doc_tokens) > 0),
langs AS (SELECT domain, lang, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaves GROUP BY ALL),
domains AS (SELECT domain, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaves GROUP BY ALL),
{_shares_sql("top", f"SELECT *, CAST(CASE domain {_TARGETS} END AS DOUBLE) AS weight, tokens * 4 AS capacity, CAST((SELECT sum(tokens) FROM leaves) AS DOUBLE) AS budget FROM domains", "domain", "", "domain")},
{_shares_sql("middle", f"SELECT langs.*, {_NODE.replace('tokens', 'langs.tokens')}, share AS budget FROM langs JOIN top USING (domain)", "domain, lang", "domain", "lang")},
{_shares_sql("leaf", f"SELECT leaves.*, {_NODE.replace('tokens', 'leaves.tokens')}, share AS budget FROM leaves JOIN middle USING (domain, lang)", "domain, lang, source", "domain, lang", "source")},
b AS (SELECT domain, lang, source, tokens, CAST(floor(share + 1e-6) AS BIGINT) AS budget FROM leaf),
o AS (SELECT d.*, CAST(budget // tokens AS INTEGER) AS whole, budget % tokens AS rest, CAST('0x' || substr(md5(concat_ws('|', '17', budget // tokens, coalesce(CAST(doc_id AS VARCHAR), ''), text_md5)), 1, 15) AS BIGINT) AS key FROM d JOIN b USING (domain, lang, source)),
u AS (SELECT *, CAST(greatest(0, least(doc_tokens, rest - (sum(doc_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, text_md5 ROWS UNBOUNDED PRECEDING) - doc_tokens))) AS BIGINT) AS part FROM o),
x AS (SELECT *, CAST(unnest(range(0, whole + 1)) AS INTEGER) AS epoch FROM u),
y AS (SELECT *, CASE WHEN epoch < whole THEN doc_tokens ELSE part END AS used_tokens FROM x)
SELECT doc_id, domain, lang, source, epoch, doc_tokens, used_tokens FROM y WHERE epoch < whole OR used_tokens > 0
"""


def op10_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as lossless WebP, read back, with features."""
    return media.read_features(media.store(table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS MATERIALIZED (
  SELECT lang, words[i : i + k - 1] AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)
  GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a FROM g WHERE len(phrase) > 1),
cuts AS (
  SELECT c.*, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = c.phrase[1 : k] JOIN g y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1 :]
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (
  SELECT lang, phrase[i : i + k - 1] AS phrase, max(a) AS within
  FROM (SELECT c.*, k, unnest(range(1, len(phrase) - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE len(phrase) > k) GROUP BY ALL
), ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(phrase, ' '))) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE within IS NULL OR 100 * within < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, and whether it is over 2048."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in every order of applying them."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o),
x AS (
  SELECT part, filter_order, step, n, good, toxic, fails, contains(fails, filter_order[step]) AS here,
         len(list_filter(range(1, step), lambda k: contains(fails, filter_order[k]))) > 0 AS gone
  FROM s, c
)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE here AND length(fails) = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (WHERE here), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_context_tree": op4_context_tree,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_html_extraction": op8_html_extraction,
        "op9_source_mixing": op9_source_mixing,
        "op10_media_webp": op10_media_webp,
        "op11_collocations": op11_collocations,
        "op12_token_counts": op12_token_counts,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_ngram_join": OP7_SQL, "op9_source_mixing": OP9_SQL, "op11_collocations": OP11_SQL, "op13_filter_audit": OP13_SQL}

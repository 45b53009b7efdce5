"""Registered queries of the learned language tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import learned as LL
from lectern.operators import vocabulary as V
from lectern.operators.joins import materialise
from lectern.sources import adapters as A


def abbreviation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: each language's abbreviations, learned from all documents."""
    return LL.abbreviations(A.documents(spark, sf_dir))


def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: sentences of every paragraph, no dot of a learned abbreviation ending one."""
    docs = A.documents(spark, sf_dir)
    table = materialise(LL.abbreviations(docs), "abbreviations")
    return LL.split_sentences_learned(A.doc_paragraphs(docs), table)


def proper_noun_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: words that capitals inside sentences mark as names."""
    return LL.proper_nouns(A.doc_paragraphs(A.documents(spark, sf_dir)))


def common_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: words of each paragraph, and those that are no proper noun by the learned table."""
    paragraphs = A.doc_paragraphs(A.documents(spark, sf_dir))
    table = materialise(LL.proper_nouns(paragraphs), "proper-nouns")
    tokens = V.tokenize(V.split_sentences(paragraphs)).filter("word <> ''")
    return LL.common_counts(tokens, table, ["user_id", "submission_id", "paragraph_number"])


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = V.corpus_statistics(A.documents(spark, sf_dir), A.quality_ids(spark, sf_dir))
    return materialise(stats.select("lang", "word", "in_lexicon"), "lexicon")


def suffix_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: suffix rules of each language, mined from its lexicon."""
    return LL.suffix_rules(_lexicon(spark, sf_dir).filter("in_lexicon").select("lang", "word"))


def learned_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 + V10: base form of every word, by its own language's rules."""
    words = _lexicon(spark, sf_dir)
    lexicon = words.filter("in_lexicon").select("lang", "word")
    rules = materialise(LL.suffix_rules(lexicon), "suffix-rules")
    return LL.lemmatise_learned(words.select("lang", "word"), lexicon, rules)


def source_frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies that no single source can make common."""
    return LL.source_frequencies(A.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (abbreviation_table, learned_sentences, proper_noun_table, common_word_counts, suffix_rule_table,
                                   learned_lemmas, source_frequency_table)}


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

_ABBREVIATIONS = r"""
dotted AS (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-ZÀ-ÿ]+(?:\.[a-zA-ZÀ-ÿ]+)*\.?')) AS token FROM documents),
types AS (SELECT lang, lower(rtrim(token, '.')) AS type, count(*) AS n, count(*) FILTER (WHERE ends_with(token, '.')) AS n_dotted
          FROM dotted GROUP BY lang, lower(rtrim(token, '.'))),
dots AS (SELECT lang, sum(n)::DOUBLE AS a, sum(n_dotted)::DOUBLE AS d FROM types GROUP BY lang),
rated AS (
  SELECT t.*, d.d / d.a AS rate, length(replace(type, '.', ''))::DOUBLE AS letters FROM types t JOIN dots d ON d.lang IS NOT DISTINCT FROM t.lang
  WHERE n_dotted > 0
),
likely AS (
  SELECT *, n_dotted * ln(0.99::DOUBLE) + (n - n_dotted) * ln(1 - 0.99::DOUBLE)
            - n_dotted * ln(rate) - CASE WHEN n = n_dotted THEN 0 ELSE (n - n_dotted) * ln(1 - rate) END AS gain FROM rated
),
abbr AS (
  SELECT lang, type, n, n_dotted, round(2 * gain * exp(-letters) * (length(type) - letters + 1) * pow(letters, -(n - n_dotted)::DOUBLE), 6) AS score FROM likely
)"""

_CASES = r"""
sents AS (
  SELECT user_id, submission_id, lang, paragraph_number, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM paras
),
toks AS (
  SELECT user_id, submission_id, lang, paragraph_number, unnest(ts) AS token, unnest(range(len(ts))) AS place
  FROM (SELECT *, regexp_extract_all(sentence, '[a-zA-ZÀ-ÿ]+') AS ts FROM sents)
),
words AS (SELECT *, lower(regexp_replace(token, '[×÷]', '', 'g')) AS word, regexp_matches(token, '^[A-ZÀ-ÖØ-Þ]') AS cap FROM toks),
cases AS (
  SELECT lang, word, count(*) FILTER (WHERE NOT cap) AS lower, count(*) FILTER (WHERE cap AND place > 0) AS capital
  FROM words WHERE word <> '' GROUP BY lang, word
),
rates AS (SELECT lang, sum(capital)::DOUBLE / nullif(sum(capital + lower), 0)::DOUBLE AS rate FROM cases GROUP BY lang),
judged AS (
  SELECT c.*, rate, coalesce(rate <= 0.2, false) AS telling, capital::DOUBLE AS k, (capital + lower)::DOUBLE AS m
  FROM cases c JOIN rates r ON r.lang IS NOT DISTINCT FROM c.lang
),
evident AS (
  SELECT *, round(1000000 * CASE WHEN m = 0 OR rate <= 0 OR rate >= 1 THEN 0.0::DOUBLE ELSE
      (CASE WHEN k / m >= rate THEN 1 ELSE -1 END) * 2 * (CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE k * ln(k / m / rate) END
       + CASE WHEN m = k THEN 0.0::DOUBLE ELSE (m - k) * ln((1 - k / m) / (1 - rate)) END) END)::BIGINT AS own FROM judged
),
abroad AS (SELECT word, sum(own) AS own FROM evident WHERE telling GROUP BY word),
names AS (
  SELECT e.lang, e.word, e.lower, e.capital, round((CASE WHEN telling THEN e.own ELSE coalesce(a.own, 0) END)::DOUBLE / 1000000.0::DOUBLE, 4) AS evidence
  FROM evident e LEFT JOIN abroad a USING (word)
),
proper AS (SELECT * FROM names WHERE evidence >= 10.83 AND capital > 0)"""

_RULES = r"""
corpus AS (
  SELECT d.lang, lower(regexp_replace(unnest(regexp_extract_all(d.text, '[a-zA-ZÀ-ÿ]+')), '[×÷]', '', 'g')) AS word,
         d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents d
),
known AS (SELECT lang, word, bool_or(good) AS in_lexicon FROM corpus WHERE word <> '' GROUP BY lang, word),
lex AS (SELECT lang, word FROM known WHERE in_lexicon),
cuts AS (SELECT lang, word, left(word, length(word) - k) AS stem, right(word, k) AS suffix
         FROM lex, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE length(word) >= 3 + k),
sizes AS (SELECT lang, suffix, count(*) AS n_words FROM cuts GROUP BY lang, suffix
          QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, suffix) <= 60),
held AS (SELECT c.* FROM cuts c JOIN sizes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.suffix = c.suffix),
pairs AS (
  SELECT a.lang, a.suffix, b.suffix AS ending, count(*) AS n_stems FROM held a
  JOIN held b ON b.lang IS NOT DISTINCT FROM a.lang AND b.stem = a.stem
   AND (length(b.suffix) < length(a.suffix) OR length(b.suffix) = length(a.suffix) AND b.suffix < a.suffix)
  GROUP BY a.lang, a.suffix, b.suffix
),
rules AS (
  SELECT p.lang, p.suffix, p.ending, p.n_stems, s.n_words FROM pairs p JOIN sizes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.suffix = p.suffix
  WHERE n_stems >= 5 AND n_stems >= 0.2::DOUBLE * n_words
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.suffix ORDER BY n_stems DESC, length(p.ending), p.ending) = 1
)"""


def oracle_sql() -> dict[str, str]:
    from lectern.plans.oracle import doc_paragraphs_cte
    paras = doc_paragraphs_cte()
    return {
        "abbreviation_table": f"WITH {_ABBREVIATIONS} SELECT * FROM abbr WHERE score >= 0.3",
        "learned_sentences": f"WITH {_ABBREVIATIONS}, {paras}" + r""",
pieces AS (
  SELECT user_id, submission_id, lang, paragraph_number, unnest(ps) AS piece, unnest(range(len(ps))) AS i
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM paras)
),
ends AS (
  SELECT p.*, a.type IS NOT NULL AS goes_on FROM pieces p LEFT JOIN (SELECT * FROM abbr WHERE score >= 0.3) a
    ON a.lang IS NOT DISTINCT FROM p.lang AND a.type = lower(regexp_extract(p.piece, '([a-zA-ZÀ-ÿ]+(?:\.[a-zA-ZÀ-ÿ]+)*)\.$', 1))
),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY submission_id, paragraph_number ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS sentence_number FROM ends
)
SELECT user_id, submission_id, lang, paragraph_number, sentence_number, regexp_replace(string_agg(piece, '' ORDER BY i), '^\s+', '') AS sentence
FROM numbered GROUP BY user_id, submission_id, lang, paragraph_number, sentence_number""",
        "proper_noun_table": f"WITH {paras}, {_CASES} SELECT * FROM proper",
        "common_word_counts": f"WITH {paras}, {_CASES}" + """
SELECT user_id, submission_id, paragraph_number, count(*) AS n_words, count(*) FILTER (WHERE p.word IS NULL) AS n_common
FROM words w LEFT JOIN proper p ON p.lang IS NOT DISTINCT FROM w.lang AND p.word = w.word
WHERE w.word <> '' GROUP BY user_id, submission_id, paragraph_number""",
        "suffix_rule_table": f"WITH {_RULES} SELECT * FROM rules",
        "learned_lemmas": f"WITH {_RULES}" + """,
forms AS (
  SELECT lang, word, word AS lemma FROM known
  UNION ALL
  SELECT k.lang, k.word, left(k.word, length(k.word) - length(r.suffix)) || r.ending FROM known k
  JOIN rules r ON r.lang IS NOT DISTINCT FROM k.lang AND ends_with(k.word, r.suffix) AND length(k.word) >= 3 + length(r.suffix)
)
SELECT f.lang, f.word, arg_min(f.lemma, (length(f.lemma), f.lemma)) AS lemma
FROM forms f JOIN lex x ON x.lang IS NOT DISTINCT FROM f.lang AND x.word = f.lemma GROUP BY f.lang, f.word""",
        "source_frequency_table": r"""
WITH tokens AS (SELECT lang, source, lower(regexp_replace(unnest(regexp_extract_all(text, '[a-zA-ZÀ-ÿ]+')), '[×÷]', '', 'g')) AS word FROM documents),
counts AS (SELECT lang, source, word, count(*) AS n FROM tokens WHERE word <> '' GROUP BY lang, source, word),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
sources AS (SELECT lang, count(*) AS sources, floor(count(*) * 0.25) AS cut FROM totals GROUP BY lang),
rated AS (
  SELECT c.*, c.n::DOUBLE / t.total::DOUBLE AS share, s.sources, s.cut,
         row_number() OVER (PARTITION BY c.lang, c.word ORDER BY c.n::DOUBLE / t.total::DOUBLE DESC, c.source) AS place
  FROM counts c JOIN totals t ON t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source
  JOIN sources s ON s.lang IS NOT DISTINCT FROM c.lang
)
SELECT lang, word, sum(n)::BIGINT AS n, count(*) AS n_sources,
       round(sum(CASE WHEN place > cut AND place <= sources - cut THEN share ELSE 0 END) / max(sources - 2 * cut), 12) AS freq
FROM rated GROUP BY lang, word"""}

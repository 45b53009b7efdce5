"""Language knowledge learned from the corpus instead of given by hand.

Each function returns a small table keyed by ``lang`` (NULL is a language of
its own) that a V operator takes in place of a hand-made list:

- ``abbreviations`` (V1): types whose dot belongs to them, by the collocation
  likelihood of "type + dot" (Kiss and Strunk's published measure);
- ``proper_nouns`` (V4): words capitalised inside sentences far more often
  than their language capitalises words;
- ``suffix_rules`` (V7): suffix replacements that many stems share;
- ``source_frequencies`` (V8b): word frequencies averaged over sources, the
  outer sources left out.

All are corpus aggregates with map-side combine; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let, scan
from lectern.operators.joins import is_small, materialise
from lectern.operators.vocabulary import _join_language, split_sentences

# Fixed values of the published abbreviation measure.
DOT_GIVEN_ABBREVIATION = 0.99
ABBREVIATION_SCORE = 0.3
DOTTED_TYPE = r"[a-zA-ZÀ-ÿ]+(?:\.[a-zA-ZÀ-ÿ]+)*\.?"
# A word is proper from this value of twice the log-likelihood ratio on (0.1 % point of chi-squared, one degree).
PROPER_EVIDENCE = 10.83
# Above this share of capitals inside sentences, a language's capitals tell nothing (German nouns).
TELLING_CAPITALS = 0.2
# Suffix rules: shortest stem, longest suffix, suffixes considered per language, stems and share a rule needs.
STEM, SUFFIX, SUFFIXES, RULE_STEMS, RULE_SHARE = 3, 4, 60, 5, 0.2
TRIMMED_SHARE = 0.25


# --------------------------------------------------------------------------
# V1: abbreviations
# --------------------------------------------------------------------------

def _x_log_y(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def dot_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, type, n, n_dotted): uses of each lower-cased type, and those with a dot right after."""
    tokens = texts.select("lang", F.explode(F.regexp_extract_all(text_col, F.lit(DOTTED_TYPE), F.lit(0))).alias("token"))
    dotted = F.col("token").endswith(".")
    return tokens.groupBy("lang", F.lower(F.rtrim("token", F.lit("."))).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dotted).alias("n_dotted"))


def abbreviations(texts: DataFrame, text_col: str = "text", least: float = ABBREVIATION_SCORE) -> DataFrame:
    """(lang, type, n, n_dotted, score) of the types that score ``least`` or more.

    The likelihood that a dot follows the type with probability 0.99 rather
    than at the language's rate, times exp(-letters), times the dots of the
    type, divided by letters to the power of its uses without a dot."""
    counts = materialise(dot_counts(texts, text_col), "dot-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("n_dotted").alias("dots"))
    rows = _join_language(counts.filter("n_dotted > 0"), totals)
    rate = F.col("dots").cast("double") / F.col("all")
    a, ab = F.col("n").cast("double"), F.col("n_dotted").cast("double")
    null = _x_log_y(ab, rate) + _x_log_y(a - ab, 1 - rate)
    alternative = ab * F.log(F.lit(DOT_GIVEN_ABBREVIATION)) + (a - ab) * F.log(F.lit(1 - DOT_GIVEN_ABBREVIATION))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("type") - letters + 1
    score = 2 * (alternative - null) * F.exp(-letters) * inner * F.pow(letters, -(a - ab))
    return (rows.withColumn("score", F.round(score, 6)).filter(F.col("score") >= least)
            .select("lang", "type", "n", "n_dotted", "score"))


def split_sentences_learned(paragraphs: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """V1 with learned abbreviations: as ``split_sentences``, but the dot of one
    of ``table(lang, type)`` ends no sentence.  White space inside a sentence
    stays as it was."""
    lists = table.groupBy("lang").agg(F.collect_set("type").alias("_types"))
    rows = _join_language(paragraphs, lists, how="left")
    keep = [c for c in paragraphs.columns if c != text_col]
    # Pieces keep the white space before them, so joined ones read as before.
    pieces = F.split(F.regexp_replace(F.col(text_col), r"(?U)([.!?])(\s+)", "$1" + T.SENTENCE_MARK + "$2"), T.SENTENCE_MARK, -1)

    def goes_on(piece: Column) -> Column:
        last = F.lower(F.regexp_extract(piece, r"([a-zA-ZÀ-ÿ]+(?:\.[a-zA-ZÀ-ÿ]+)*)\.$", 1))
        return F.coalesce(F.array_contains("_types", last), F.lit(False))

    zero = F.struct(F.lit("").alias("held"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        return F.struct(F.when(state["open"], F.concat(state["held"], piece)).otherwise(piece).alias("held"), goes_on(piece).alias("open"),
                        F.when(~state["open"], state["held"]).alias("out"))

    def sentences(ps: Column) -> Column:
        walked, read = scan(ps, zero, step, lambda s: s["out"], F.array().cast("array<string>"))
        # The first output is the empty start; the last sentence is still held.
        return let(let(walked, read), lambda w: F.concat(
            F.filter(F.slice(w["out"], 2, F.greatest(F.size(w["out"]) - 1, F.lit(0))), lambda x: x.isNotNull()), F.array(w["state"]["held"])))

    stripped = F.transform(let(pieces, sentences), lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))
    whole = F.when(F.col(text_col).isNotNull(), stripped)
    return rows.select(*keep, F.posexplode(whole).alias("sentence_number", "sentence"))


# --------------------------------------------------------------------------
# V4: proper nouns
# --------------------------------------------------------------------------

def _evidence(k: Column, n: Column, rate: Column) -> Column:
    """Twice the log-likelihood ratio of k of n against a rate, negative below it."""
    own = k / n
    value = 2 * (_x_log_y(k, own / rate) + _x_log_y(n - k, (1 - own) / (1 - rate)))
    return F.when((rate <= 0) | (rate >= 1), F.lit(0.0)).when(own >= rate, value).otherwise(-value)


def case_counts(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, word, lower, capital, initial): uses in lower case, capitalised
    inside a sentence, and first in a sentence."""
    tokens = split_sentences(paragraphs.select("lang", text_col), text_col).select(
        "lang", F.posexplode(T.letter_tokens("sentence")).alias("at", "token"))
    upper = T.is_capitalised("token")
    return (tokens.groupBy("lang", T.normalise_token("token").alias("word")).agg(
        F.count_if(~upper).alias("lower"), F.count_if(upper & (F.col("at") > 0)).alias("capital"),
        F.count_if(upper & (F.col("at") == 0)).alias("initial")).filter("word <> ''"))


def proper_nouns(paragraphs: DataFrame, text_col: str = "text", least: float = PROPER_EVIDENCE) -> DataFrame:
    """(lang, word, lower, capital, evidence) of the words that are proper.

    Evidence is the likelihood ratio of the word's capitals inside sentences
    against its language's share of them.  Where a language capitalises so
    much that this tells nothing, a word is judged by the languages where it
    does: names are spelt alike there, common nouns are not."""
    counts = materialise(case_counts(paragraphs, text_col), "case-counts")
    rates = counts.groupBy("lang").agg((F.sum("capital") / F.sum(F.col("capital") + F.col("lower"))).alias("rate"))
    rows = _join_language(counts, rates).withColumn("telling", F.coalesce(F.col("rate") <= TELLING_CAPITALS, F.lit(False)))
    n = (F.col("lower") + F.col("capital")).cast("double")
    rows = rows.withColumn("own", F.when(n > 0, _evidence(F.col("capital").cast("double"), n, F.col("rate"))).otherwise(0.0))
    # Summed in steps of a millionth, so that the order of the sum is of no effect.
    whole = F.round(F.col("own") * 1_000_000).cast("long")
    elsewhere = rows.filter("telling").groupBy("word").agg(F.sum(whole).alias("_abroad"))
    judged = rows.join(elsewhere, "word", "left")
    evidence = F.when(F.col("telling"), whole).otherwise(F.coalesce("_abroad", F.lit(0))) / 1_000_000.0
    return (judged.withColumn("evidence", F.round(evidence, 4)).filter((F.col("evidence") >= least) & (F.col("capital") > 0))
            .select("lang", "word", "lower", "capital", "evidence"))


def without_proper_nouns(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """V4: ``tokens(lang, word, ...)`` whose word is not in ``table``, whatever its case."""
    return _join_language(tokens, table.select("lang", "word"), "word", how="left_anti")


def common_counts(tokens: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_words, n_common): the tokens of each key, and those whose word is
    not in the stored ``table(lang, word)``.

    A table that can be broadcast meets the tokens where the text is read, so
    only counts per key move; else each key's distinct words do."""
    names = table.select("lang", "word").withColumn("proper", F.lit(True))
    if is_small(names):
        marked = _join_language(tokens.select("lang", *key, "word"), F.broadcast(names), "word", how="left")
        return marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("proper").isNull()).alias("n_common"))
    words = tokens.groupBy("lang", *key, "word").agg(F.count(F.lit(1)).alias("n"))
    marked = _join_language(words, names, "word", how="left")
    return marked.groupBy(*key).agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("proper").isNull(), F.col("n")).otherwise(0)).alias("n_common"))


# --------------------------------------------------------------------------
# V7: suffix rules
# --------------------------------------------------------------------------

def _cuts(words: DataFrame, longest: int = SUFFIX) -> DataFrame:
    """(lang, word, stem, suffix) for every suffix of up to ``longest`` letters, the empty one included."""
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word") - STEM))).alias("k")
    cut = words.filter(F.length("word") >= STEM).select("lang", "word", k)
    return cut.select("lang", "word", F.expr("left(word, length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("suffix"))


def suffix_rules(words: DataFrame) -> DataFrame:
    """(lang, suffix, ending, n_stems, n_words): a word in ``suffix`` has a base
    form in ``ending``.  ``words(lang, word)`` are distinct.

    Considered are each language's SUFFIXES commonest suffixes, so a stem has
    at most that many and the pairs on it are bounded.  For each suffix the
    shorter (or equally long) ending that most of its stems share wins, if
    RULE_STEMS stems and RULE_SHARE of the suffix's words have it."""
    cuts = materialise(_cuts(words), "suffix-cuts")
    sizes = cuts.groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("n_words"))
    by_size = Window.partitionBy("lang").orderBy(F.desc("n_words"), "suffix")
    common = materialise(sizes.withColumn("_r", F.row_number().over(by_size)).filter(F.col("_r") <= SUFFIXES).drop("_r"), "suffixes")
    known = _join_language(cuts, common.select("lang", "suffix"), "suffix", how="left_semi")
    signatures = known.groupBy("lang", "stem").agg(F.array_sort(F.collect_set("suffix")).alias("s")).filter(F.size("s") > 1)
    pairs = (signatures.select("lang", "s", F.explode("s").alias("suffix")).select("lang", "suffix", F.explode("s").alias("ending"))
             .filter((F.length("ending") < F.length("suffix")) | (F.length("ending") == F.length("suffix")) & (F.col("ending") < F.col("suffix")))
             .groupBy("lang", "suffix", "ending").agg(F.count(F.lit(1)).alias("n_stems")))
    scored = _join_language(pairs, common, "suffix").filter(
        (F.col("n_stems") >= RULE_STEMS) & (F.col("n_stems") >= RULE_SHARE * F.col("n_words")))
    best = Window.partitionBy("lang", "suffix").orderBy(F.desc("n_stems"), F.length("ending"), "ending")
    return (scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
            .select("lang", "suffix", "ending", "n_stems", "n_words"))


def lemmatise_learned(words: DataFrame, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """V7+V10 with learned rules: (lang, word, lemma) of the words with a base
    form in ``lexicon(lang, word)``: the shortest of the word itself and one
    rule's result, ties in alphabetical order."""
    applied = _join_language(_cuts(words).filter("suffix <> ''"), rules.select("lang", "suffix", "ending"), "suffix")
    candidates = words.select("lang", "word", F.col("word").alias("lemma")).unionByName(
        applied.select("lang", "word", F.concat("stem", "ending").alias("lemma")))
    valid = _join_language(candidates.withColumn("lemma_key", F.col("lemma")), lexicon.select("lang", F.col("word").alias("lemma_key")),
                           "lemma_key", how="left_semi")
    first = F.min(F.struct(F.length("lemma").alias("length"), "lemma"))
    return valid.groupBy("lang", "word").agg(first.alias("best")).select("lang", "word", "best.lemma")


# --------------------------------------------------------------------------
# Frequencies across sources
# --------------------------------------------------------------------------

def source_frequencies(texts: DataFrame, text_col: str = "text", trim: float = TRIMMED_SHARE) -> DataFrame:
    """(lang, word, n, n_sources, freq): the mean of a word's relative frequency
    over its language's sources, without the ``trim`` share of them where it is
    most and where it is least frequent.  Sources without the word count as 0,
    so the jargon of a few sources is not common.  A NULL source is one."""
    tokens = texts.select("lang", "source", F.explode(T.letter_tokens(text_col)).alias("token"))
    counts = materialise(tokens.groupBy("lang", "source", T.normalise_token("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n")).filter("word <> ''"), "source-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    right = totals.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rated = counts.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "share", F.col("n").cast("double") / F.col("total")).drop("_lang", "_source", "total")
    falling = Window.partitionBy("lang", "word").orderBy(F.desc("share"), "source")
    ranked = _join_language(rated.withColumn("place", F.row_number().over(falling)), sources)
    cut = F.floor(F.col("sources") * trim)
    inside = (F.col("place") > cut) & (F.col("place") <= F.col("sources") - cut)
    return (ranked.groupBy("lang", "word").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"),
        F.round(F.sum(F.when(inside, F.col("share")).otherwise(0.0)) / F.max(F.col("sources") - 2 * cut), 12).alias("freq")))

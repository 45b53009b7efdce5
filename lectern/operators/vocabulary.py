"""Vocabulary mining (V1-V14): uncommon words per submission.

Plan shape (see ``uncommon_words``):

1. Reference side, independent of the documents being analysed: the
   distinct words of the frequency table are tagged, lemmatised against
   the lexicon with the fixed detachment rules, scored and filtered to
   *valid and uncommon*.  This word -> (lemma, frequency) map is at most
   (#lexicon words x rules) rows; it is written as Parquet, and Spark
   broadcasts it if its size allows.
2. Document side, one narrow pass: paragraphs -> sentences -> tokens
   (nested arrays, one ``posexplode``), proper-noun filter, normalise, then an
   inner join with the map that drops every common or invalid token map-side.
   A token carries its place as packed numbers, not its sentence.
3. One shuffle on (submission, lemma) with partial hash aggregation for
   count / first place / frequency, then a per-submission
   ``row_number`` for the rarity rank (at most one row per lexicon word
   per submission).
4. The first sentence of each word is joined from the paragraphs by place;
   V14 and the study guide, which do not read it, stop at ``ranked_words``.

Differences from the model-based original, all table driven so real
lexicons can be plugged in: sentences are split by rule, proper nouns
are "capitalised and not sentence-initial" unless a ``pos_tags`` table
is supplied, the part of speech comes from ``pos_tags`` or a small
suffix heuristic, and lemmas come from the published WordNet detachment
rules checked against the lexicon table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let
from lectern.operators.joins import broadcast_if_small, is_small, materialise

DEFAULT_THRESHOLD = 2e-5
_KEY = ["user_id", "submission_id"]

# WordNet's published morphological detachment rules,
# (suffix, ending) per lemma class, in the order they are tried.
DETACHMENT_RULES = {
    "noun": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
             ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "verb": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"),
             ("ed", ""), ("ing", "e"), ("ing", "")],
    "adj": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "adv": [],
}

# Part-of-speech tag prefixes mapped to lemma classes
# (anything else is treated as a noun).
TAG_CLASSES = [("J", "adj"), ("V", "verb"), ("N", "noun"), ("R", "adv")]

# Fixed values of this package's own stand-in tagger (used when no
# ``pos_tags`` table is given): a word of at least MIN_SUFFIX_WORD
# characters ending in one of these suffixes gets the tag.
SUFFIX_TAGS = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"),
               ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"),
               ("less", "JJ")]
MIN_SUFFIX_WORD = 5
PROPER_TAGS = ("NNP", "NNPS")


# --------------------------------------------------------------------------
# V1-V5: document side, narrow
# --------------------------------------------------------------------------

def split_sentences(paragraphs: DataFrame, text_col: str = "text",
                    abbreviations: list[str] | None = None) -> DataFrame:
    """V1: one row per sentence with its 0-based ``sentence_number``."""
    keep = [c for c in paragraphs.columns if c != text_col]
    return paragraphs.select(
        *keep, F.posexplode(T.sentences(text_col, abbreviations)).alias("sentence_number", "sentence"))


def tokenize(sentences: DataFrame, contractions: bool = False) -> DataFrame:
    """V2-V5: letter tokens with position, proper-noun flag and normalised word.

    Proper-noun test (stand-in for NNP/NNPS tags): capitalised and not the
    first token of its sentence.  ``contractions`` applies the Treebank
    contraction splits before tokenising.
    """
    toks = sentences.select(
        "*", F.posexplode(T.letter_tokens("sentence", contractions)).alias("token_number", "token"))
    return (toks
            .withColumn("is_proper", T.is_capitalised("token") & (F.col("token_number") > 0))
            .withColumn("word", T.normalise_token("token"))
            .drop("token"))


def token_counts(paragraphs: DataFrame) -> DataFrame:
    """V2-V5 counted: (user_id, submission_id, paragraph_number, tokens,
    kept_tokens, distinct_words) of every paragraph that has a token.

    One row is one paragraph: its words are counted where they stand, and
    nothing is shuffled.  Where rows share a paragraph number, use
    :func:`token_counts_by_key`."""
    def kept(tokens: Column) -> Column:
        """The normalised words of one sentence after the proper-noun filter."""
        common = F.filter(tokens, lambda t, i: ~(T.is_capitalised(t) & (i > 0)))
        return F.filter(F.transform(common, lambda t: T.normalise_token(t)), lambda w: w != "")

    sentences = F.transform(T.sentences("text"), lambda s: T.letter_tokens(s))
    counts = let(sentences, lambda per_sentence: let(F.flatten(F.transform(per_sentence, kept)), lambda words: F.struct(
        F.size(F.flatten(per_sentence)).cast("bigint").alias("tokens"), F.size(words).cast("bigint").alias("kept_tokens"),
        F.size(F.array_distinct(words)).cast("bigint").alias("distinct_words"))))
    # Inside the generator, so that no filter on it repeats the work.
    found = F.explode(F.filter(F.array(counts), lambda c: c["tokens"] > 0)).alias("c")
    return paragraphs.select(*_KEY, "paragraph_number", found).select(*_KEY, "paragraph_number", "c.*")


def token_counts_by_key(paragraphs: DataFrame) -> DataFrame:
    """:func:`token_counts` where several rows may share a paragraph number: they
    count as one paragraph, and its words meet in a shuffle."""
    toks = tokenize(split_sentences(paragraphs))
    kept = ~F.col("is_proper") & (F.col("word") != "")
    return (toks.groupBy(*_KEY, "paragraph_number")
            .agg(F.count(F.lit(1)).alias("tokens"), F.count_if(kept).alias("kept_tokens"),
                 F.count_distinct(F.when(kept, F.col("word"))).alias("distinct_words")))


def heuristic_tag(word: Column) -> Column:
    """Suffix-based stand-in tag; ``NN`` when nothing matches."""
    expr = None
    for suffix, tag in SUFFIX_TAGS:
        cond = word.endswith(suffix) & (F.length(word) >= MIN_SUFFIX_WORD)
        expr = F.when(cond, tag) if expr is None else expr.when(cond, tag)
    return expr.otherwise("NN")


def lemma_class(tag: Column) -> Column:
    """V6: tag prefix -> lemma class, default noun."""
    first = F.substring(tag, 1, 1)
    expr = None
    for prefix, cls in TAG_CLASSES:
        expr = F.when(first == prefix, cls) if expr is None else expr.when(first == prefix, cls)
    return expr.otherwise("noun")


def _rules() -> list[tuple[int, str, str, str]]:
    """(rule number from 1, class, suffix, ending) in trial order."""
    out, order = [], 0
    for pos, rules in DETACHMENT_RULES.items():
        for suffix, ending in rules:
            order += 1
            out.append((order, pos, suffix, ending))
    return out


def _apply_rule(word: Column, suffix: str, ending: str) -> Column:
    return F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(ending))


def _candidates(word: Column, cls: Column) -> Column:
    """The word itself (rule 0) plus every rule result for its class, as
    ``struct(rank, lemma)``; ``rank = length * 64 + rule`` orders shortest
    first, then the word itself, then rule order."""
    items = [F.struct((F.length(word) * 64).alias("rank"), word.alias("lemma"))]
    for order, pos, suffix, ending in _rules():
        base = _apply_rule(word, suffix, ending)
        items.append(F.when((cls == pos) & word.endswith(suffix),
                            F.struct((F.length(base) * 64 + order).alias("rank"), base.alias("lemma"))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _lemma_of(word: Column, rule: Column) -> Column:
    """Recompute the candidate of ``rule`` for ``word`` (rule 0 = itself)."""
    expr = F.when(rule == 0, word)
    for order, _, suffix, ending in _rules():
        expr = expr.when(rule == order, _apply_rule(word, suffix, ending))
    return expr


def lemmatise(words: DataFrame, lexicon: DataFrame, pos_tags: DataFrame | None = None,
              exceptions: DataFrame | None = None) -> DataFrame:
    """V6+V7+V10 on distinct words: ``(lang, word) -> lemma`` for valid words only.

    A candidate counts only if it is in ``lexicon(lang, word)``; the
    shortest wins (ties: the word itself, then rule order).  Words with no
    candidate in the lexicon keep themselves as lemma and are invalid, so
    they are not returned.  The winner is found with an integer ``min``
    (hash aggregate) and its text recomputed from (word, rule).

    ``exceptions(word, cls, lemma)`` lists irregular forms (``geese`` ->
    ``goose``): for a listed (word, class) the candidates are the word and
    its listed lemmas instead of the rule results (ties: the word, then
    the lemmas in alphabetical order).
    """
    if pos_tags is not None:
        tagged = words.join(pos_tags.select("word", "tag"), "word", "left")
        tag = F.coalesce(F.col("tag"), heuristic_tag(F.col("word")))
    else:
        tagged = words
        tag = heuristic_tag(F.col("word"))
    classed = tagged.select("lang", "word", lemma_class(tag).alias("cls"))
    lex = lexicon.select("lang", F.col("word").alias("lemma_key"))
    if exceptions is None:
        cands = classed.select("lang", "word", F.explode(_candidates(F.col("word"), F.col("cls"))).alias("c"))
        found = _join_language(cands.withColumn("lemma_key", F.col("c.lemma")), lex, "lemma_key", how="left_semi")
        best = found.groupBy("lang", "word").agg(F.min("c.rank").alias("rank"))
        return best.select("lang", "word", _lemma_of(F.col("word"), F.col("rank") % 64).alias("lemma"))
    listed = exceptions.groupBy("word", "cls").agg(F.array_sort(F.collect_set("lemma")).alias("exc"))
    classed = classed.join(listed, ["word", "cls"], "left")
    irregular = F.transform(F.col("exc"), lambda l, i: F.struct(
        (F.length(l) * 64 + i + 1).alias("rank"), l.alias("lemma")))
    own = F.array(F.struct((F.length("word") * 64).alias("rank"), F.col("word").alias("lemma")))
    options = F.when(F.col("exc").isNotNull(), F.concat(own, irregular)) \
        .otherwise(_candidates(F.col("word"), F.col("cls")))
    cands = classed.select("lang", "word", F.explode(options).alias("c"))
    found = _join_language(cands.withColumn("lemma_key", F.col("c.lemma")), lex, "lemma_key", how="left_semi")
    # Listed lemmas cannot be recomputed from a rule number: keep the text.
    best = found.groupBy("lang", "word").agg(F.min_by("c.lemma", "c.rank").alias("lemma"))
    return best.select("lang", "word", "lemma")


def _normalised_words(texts: DataFrame, text_col: str, *extra: str, contractions: bool = False) -> DataFrame:
    text = T.split_contractions(text_col) if contractions else F.col(text_col)
    return texts.select("lang", *extra, F.explode(T.normalised_tokens(text)).alias("word"))


def _join_language(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on ``lang`` and ``keys``; NULL is a language of its own."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in ("lang", *keys)})
    same = F.col("lang").eqNullSafe(F.col("_right_lang"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(right, same, how).drop("_right_lang", *(f"_right_{k}" for k in keys))


def _with_frequency(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return (_join_language(counts, totals)
            .withColumn("freq", F.col("n").cast("double") / F.col("total").cast("double"))
            .drop("total"))


def word_frequencies(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Relative frequency of every normalised token per language.

    Two-level aggregate: counts per (lang, word) with map-side partial
    aggregation, totals per language joined back.
    """
    counts = _normalised_words(texts, text_col).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return _with_frequency(counts).select("lang", "word", "n", "freq")


def corpus_statistics(texts: DataFrame, lexicon_doc_ids: DataFrame, text_col: str = "text",
                      contractions: bool = False) -> DataFrame:
    """V8b and the lexicon in one pass over the corpus:
    ``(lang, word, n, freq, in_lexicon)``; ``in_lexicon`` is true when the
    word occurs in a document listed in ``lexicon_doc_ids(doc_id)``.

    Tables bucketed by ``doc_id`` join without moving any text."""
    ids = lexicon_doc_ids.select("doc_id").distinct().withColumn("_lex", F.lit(True))
    flagged = texts.join(ids, "doc_id", "left").withColumn("_lex", F.coalesce("_lex", F.lit(False)))
    counts = (_normalised_words(flagged, text_col, "_lex", contractions=contractions).groupBy("lang", "word")
              .agg(F.count(F.lit(1)).alias("n"), F.bool_or("_lex").alias("in_lexicon")))
    # Totals that read the flag too have the counts' own shuffle, which Spark then runs once.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if("in_lexicon").alias("listed"))
    return _join_language(counts, totals).select(
        "lang", "word", "n", (F.col("n").cast("double") / F.col("total").cast("double")).alias("freq"),
        (F.col("in_lexicon") & (F.col("listed") > 0)).alias("in_lexicon"))


def lookup_frequency(df: DataFrame, frequency: DataFrame, key: str = "lemma") -> DataFrame:
    """V8: attach ``freq`` of ``key``; unknown words get 0.0."""
    f = frequency.select("lang", F.col("word").alias(key), F.col("freq").alias("_f"))
    return _join_language(df, f, key, how="left").withColumn("freq", F.coalesce("_f", F.lit(0.0))).drop("_f")


def uncommon(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """V9: strictly below the threshold."""
    return df.filter(F.col("freq") < F.lit(float(threshold)))


def uncommon_lemma_map(frequency: DataFrame, lexicon: DataFrame | None = None,
                       threshold: float = DEFAULT_THRESHOLD, pos_tags: DataFrame | None = None,
                       exceptions: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """V6-V10 on the distinct words of the frequency table:
    ``(lang, word, lemma, freq)`` for valid, uncommon lemmas only.

    The frequency table is used twice (as the word list and for the lemma
    lookup), so it is materialised once, unless it is ``stored`` already.  With
    ``lexicon=None`` the lexicon is the table's ``in_lexicon`` words.
    """
    freq = frequency if stored else materialise(frequency)
    if lexicon is None:
        lexicon = freq.filter("in_lexicon").select("lang", "word")
    words = freq.select("lang", "word")
    return uncommon(lookup_frequency(lemmatise(words, lexicon, pos_tags, exceptions), freq), threshold)


# --------------------------------------------------------------------------
# V11-V14
# --------------------------------------------------------------------------

def paragraph_tokens(paragraphs: DataFrame, contractions: bool = False,
                     abbreviations: list[str] | None = None) -> DataFrame:
    """V1-V5 without the sentences' text: one row per token of a paragraph,
    placed by two numbers that grow in reading order, ``sentence_at``
    (paragraph, sentence) and ``token_at`` (paragraph, token of the paragraph),
    each packed in one BIGINT with 32 bits for the second number."""
    per_sentence = F.transform(T.sentences("text", abbreviations), lambda s, i: F.transform(
        T.letter_tokens(s, contractions), lambda t, j: F.struct(
            i.alias("sentence_number"), j.alias("token_number"), t.alias("token"))))
    paragraph = F.shiftleft(F.col("paragraph_number").cast("bigint"), 32)
    tokens = paragraphs.select(*_KEY, "lang", "paragraph_number", F.posexplode(F.flatten(per_sentence)).alias("at", "t"))
    return tokens.select(
        *_KEY, "lang", paragraph.bitwiseOR(F.col("t.sentence_number").cast("bigint")).alias("sentence_at"),
        paragraph.bitwiseOR(F.col("at").cast("bigint")).alias("token_at"),
        (T.is_capitalised("t.token") & (F.col("t.token_number") > 0)).alias("is_proper"),
        T.normalise_token("t.token").alias("word"))


def placed_words(paragraphs: DataFrame) -> DataFrame:
    """The kept tokens of :func:`paragraph_tokens` without ``sentence_at``, for
    whoever does not read the sentences: a paragraph's words are found in its text,
    and no sentence is made.  ``token_at`` numbers the kept tokens only."""
    paragraph = F.shiftleft(F.col("paragraph_number").cast("bigint"), 32)
    words = paragraphs.select(*_KEY, "lang", "paragraph_number",
                              F.posexplode(T.normalised_tokens(T.without_proper("text"))).alias("at", "word"))
    return words.select(*_KEY, "lang", paragraph.bitwiseOR(F.col("at").cast("bigint")).alias("token_at"), "word")


def aggregate_words(hits: DataFrame) -> DataFrame:
    """Count, first occurrence and frequency per (submission, lemma).

    The places grow in reading order, so their minima belong to the same
    occurrence; numbers only, so the aggregate stays hash based."""
    places = [F.min(c).alias(c) for c in ("sentence_at", "token_at") if c in hits.columns]
    return hits.groupBy(*_KEY, "lemma").agg(F.count(F.lit(1)).alias("count"), *places, F.max("freq").alias("language_frequency"))


def aggregate_gathered(hits: DataFrame) -> DataFrame:
    """:func:`aggregate_words` for submissions of one row each: their hits move
    by submission, at once to where they are ranked.  A rare word seldom stands
    twice in a text, so aggregating before would hold in memory nearly all hits
    of a task and move no fewer rows, twice."""
    places = [c for c in ("sentence_at", "token_at") if c in hits.columns]
    return aggregate_words(hits.select(*_KEY, "lemma", *places, "freq").repartition(*_KEY))


def rank_words(words: DataFrame) -> DataFrame:
    """Frequency descending, ties in first-seen order."""
    w = Window.partitionBy(*_KEY).orderBy(F.col("language_frequency").desc(), F.col("token_at"))
    places = [c for c in ("sentence_at",) if c in words.columns]
    return words.select(
        *_KEY, F.col("lemma").alias("word"), "count", *places,
        F.shiftright("token_at", 32).cast("int").alias("first_paragraph"),
        "language_frequency", F.row_number().over(w).alias("rank"))


def attach_sentences(ranked: DataFrame, paragraphs: DataFrame, abbreviations: list[str] | None = None) -> DataFrame:
    """The first sentence of each ranked word, read from its paragraph: the
    text moves once, not with every token.  A (submission, paragraph number)
    names one paragraph; NULL keys match as values."""
    texts = split_sentences(paragraphs.select(*_KEY, "paragraph_number", "text"), abbreviations=abbreviations)
    place = F.shiftleft(F.col("paragraph_number").cast("bigint"), 32).bitwiseOR(F.col("sentence_number").cast("bigint"))
    texts = texts.select(F.col("user_id").alias("_user"), F.col("submission_id").alias("_submission"),
                         place.alias("_at"), F.col("sentence").alias("first_sentence"))
    same = (F.col("user_id").eqNullSafe(F.col("_user")) & F.col("submission_id").eqNullSafe(F.col("_submission"))
            & (F.col("sentence_at") == F.col("_at")))
    return ranked.join(texts, same).select(
        *_KEY, "word", "count", "first_sentence", "first_paragraph", "language_frequency", "rank")


def prepare_lemma_map(frequency: DataFrame, lexicon: DataFrame | None = None,
                      threshold: float = DEFAULT_THRESHOLD, pos_tags: DataFrame | None = None,
                      exceptions: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """The reference side of V13, computed once and stored (reusable across
    batches of a stream)."""
    return materialise(uncommon_lemma_map(frequency, lexicon, threshold, pos_tags, exceptions, stored), "lemma-map")


def frequent_words(frequency: DataFrame, lemma_map: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Words that are at least ``threshold`` frequent and not in the map: most of
    a text's tokens, yet at most ``1 / threshold`` words a language."""
    common = frequency.filter(F.col("freq") >= F.lit(float(threshold))).select("lang", "word")
    return materialise(_join_language(common, lemma_map.select("lang", "word"), "word", how="left_anti"), "frequent-words")


def ranked_words(paragraphs: DataFrame, frequency: DataFrame | None = None, lexicon: DataFrame | None = None,
                 threshold: float = DEFAULT_THRESHOLD, pos_tags: DataFrame | None = None,
                 lemma_map: DataFrame | None = None, exceptions: DataFrame | None = None,
                 contractions: bool = False, abbreviations: list[str] | None = None,
                 repeated: DataFrame | None = None, sentences: bool = True) -> DataFrame:
    """V13 without the sentences' text: (user_id, submission_id, word, count,
    sentence_at, first_paragraph, language_frequency, rank); parameters as in
    :func:`uncommon_words`.  ``paragraphs`` come from one row a submission and
    ``repeated`` from the others, if given; without, any paragraphs may come.
    Without ``sentences`` there is no ``sentence_at`` and less work.

    The map is stored Parquet: it is broadcast while its files are small
    (``joins.BROADCAST_BYTES``); otherwise the tokens are shuffled, AQE splitting hot words, and
    the frequent words that the map lacks are dropped first, where the text is
    read, so that only rare tokens are shuffled then.
    """
    stats = None
    if lemma_map is None:
        stats = materialise(frequency)
        lemma_map = prepare_lemma_map(stats, lexicon, threshold, pos_tags, exceptions, stored=True)
    common = frequent_words(stats, lemma_map, threshold) if stats is not None and not is_small(lemma_map) else None
    plain = not (sentences or contractions or abbreviations or pos_tags is not None)

    def hits(rows: DataFrame) -> DataFrame:
        toks = placed_words(rows) if plain else paragraph_tokens(rows, contractions, abbreviations)
        if common is not None:
            toks = _join_language(toks, common, "word", how="left_anti")
        if pos_tags is not None:
            proper = pos_tags.filter(F.col("tag").isin(*PROPER_TAGS)).select("word").distinct().withColumn("_p", F.lit(True))
            toks = toks.join(proper, "word", "left").withColumn("is_proper", F.coalesce("_p", F.lit(False))).drop("_p")
        if not plain:
            toks = toks.filter(~F.col("is_proper") & (F.col("word") != ""))
        return _join_language(toks if sentences else toks.drop("sentence_at"), broadcast_if_small(lemma_map), "word")

    if repeated is None:
        return rank_words(aggregate_words(hits(paragraphs)))
    return rank_words(aggregate_gathered(hits(paragraphs))).unionByName(rank_words(aggregate_words(hits(repeated))))


def frequency_profile(texts: DataFrame, frequency: DataFrame, threshold: float, repeated: DataFrame) -> DataFrame:
    """How many uncommon words of a submission have which frequency:
    (user_id, submission_id, language_frequency, words).

    ``texts`` and ``repeated`` are one row a document, its paragraphs joined by
    ``SENTENCE_MARK``: of submissions of one document, and of the others.

    A lemma that a single word of its language has is counted by that word where
    the text is read; only hits of words that share their lemma, and of repeated
    submissions, meet by submission and lemma."""
    stats = materialise(frequency)
    lemma_map = prepare_lemma_map(stats, threshold=threshold, stored=True)
    common = None if is_small(lemma_map) else frequent_words(stats, lemma_map, threshold)
    shared = materialise(lemma_map.groupBy("lang", "lemma").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared-lemmas")
    forms = materialise(_join_language(lemma_map, broadcast_if_small(shared), "lemma", how="left").select(
        "lang", "word", "freq", "lemma", F.col("_n").isNotNull().alias("shared")), "lemma-forms")

    def hits(rows: DataFrame) -> DataFrame:
        words = rows.select(*_KEY, "lang", F.explode(F.array_distinct(T.normalised_tokens(T.without_proper("text")))).alias("word"))
        if common is not None:
            words = _join_language(words, common, "word", how="left_anti")
        return _join_language(words, broadcast_if_small(forms), "word")

    own = hits(texts).withColumn("lemma", F.when(F.col("shared"), F.col("lemma"))).groupBy(
        *_KEY, "lemma", "freq").agg(F.count(F.lit(1)).alias("n"))
    counted = own.select(*_KEY, F.col("freq").alias("language_frequency"),
                         F.when(F.col("lemma").isNull(), F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("words"))
    met = hits(repeated).groupBy(*_KEY, "lemma").agg(F.max("freq").alias("language_frequency"))
    return counted.unionByName(met.select(*_KEY, "language_frequency", F.lit(1).cast("bigint").alias("words")))


def uncommon_words(paragraphs: DataFrame, frequency: DataFrame | None = None, lexicon: DataFrame | None = None,
                   threshold: float = DEFAULT_THRESHOLD, pos_tags: DataFrame | None = None,
                   lemma_map: DataFrame | None = None, exceptions: DataFrame | None = None,
                   contractions: bool = False, abbreviations: list[str] | None = None,
                   repeated: DataFrame | None = None) -> DataFrame:
    """V13 ``parse_paragraphs`` for every submission at once.

    ``paragraphs``: (user_id, submission_id, lang, paragraph_number, text).
    Either ``frequency`` (and optionally ``lexicon`` and ``exceptions``) or
    a ``lemma_map`` from ``prepare_lemma_map`` supplies the reference side;
    ``contractions`` applies the Treebank contraction splits to the text;
    ``abbreviations`` lists words whose trailing dot does not end a sentence;
    ``repeated`` as in :func:`ranked_words`.
    Returns (user_id, submission_id, word, count, first_sentence,
    first_paragraph, language_frequency, rank).
    """
    ranked = ranked_words(paragraphs, frequency, lexicon, threshold, pos_tags, lemma_map, exceptions,
                          contractions, abbreviations, repeated)
    texts = paragraphs if repeated is None else paragraphs.unionByName(repeated)
    return attach_sentences(ranked, texts, abbreviations)


def vocabulary_rows(words: DataFrame) -> DataFrame:
    """The persisted projection (count, sentence, frequency dropped).

    The rarity ``rank`` is kept (the original computed it and then lost it
    on persist), so readers can list words by rarity as well as by key."""
    return words.select(*_KEY, F.col("first_paragraph").alias("paragraph_number"), "word", "rank")

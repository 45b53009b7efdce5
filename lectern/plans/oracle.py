"""DuckDB twins of the registered queries (the correctness oracle).

Each string runs in DuckDB over the driver tables registered as views.
Adapters are written once here as CTE text and reused.  DuckDB regexes
are RE2: no lookaround, ``\\s`` is ASCII, ``regexp_replace`` needs the
``'g'`` flag and ``\\1`` back-references.
"""

from __future__ import annotations

from lectern.operators import vocabulary as V

# --------------------------------------------------------------------------
# Adapter CTEs
# --------------------------------------------------------------------------

CLEAN = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def clean(x: str) -> str:
    return CLEAN.format(x=x)


def doc_paragraphs_cte(lang_filter: str = "", min_length: int = 100) -> str:
    where = f"WHERE lang = '{lang_filter}'" if lang_filter else ""
    return f"""
docs AS (SELECT doc_id, source, lang, text FROM documents {where}),
paras AS (
  SELECT source AS user_id, doc_id AS submission_id, lang,
         unnest(ps) AS text, unnest(range(len(ps)))::INTEGER AS paragraph_number
  FROM (SELECT source, doc_id, lang,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: {clean('x')}),
                           lambda x: length(x) >= {min_length}) AS ps
        FROM docs)
)"""


def _rules_values() -> str:
    rows, order = [], 0
    for pos, rules in V.DETACHMENT_RULES.items():
        for suffix, ending in rules:
            order += 1
            rows.append(f"('{pos}', {order}, '{suffix}', '{ending}')")
    return ", ".join(rows)


def _tag_case(x: str) -> str:
    parts = [f"WHEN ends_with({x}, '{s}') AND length({x}) >= {V.MIN_SUFFIX_WORD} THEN '{t}'"
             for s, t in V.SUFFIX_TAGS]
    return "CASE " + " ".join(parts) + " ELSE 'NN' END"


def _class_case(tag: str) -> str:
    parts = [f"WHEN left({tag}, 1) = '{p}' THEN '{c}'" for p, c in V.TAG_CLASSES]
    return "CASE " + " ".join(parts) + " ELSE 'noun' END"


def vocabulary_ctes(lang_filter: str = "", threshold: float = V.DEFAULT_THRESHOLD) -> str:
    """CTEs ending in ``ranked`` = V13 output for every submission."""
    where = f"AND d.lang = '{lang_filter}'" if lang_filter else ""
    return doc_paragraphs_cte(lang_filter) + f""",
corpus AS (
  SELECT lang, lower(regexp_replace(t, '[×÷]', '', 'g')) AS word
  FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-ZÀ-ÿ]+')) AS t FROM docs)
),
counts AS (SELECT lang, word, count(*) AS n FROM corpus WHERE word <> '' GROUP BY lang, word),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
wfreq AS (SELECT c.lang, c.word, c.n::DOUBLE / t.total::DOUBLE AS freq FROM counts c JOIN totals t ON t.lang IS NOT DISTINCT FROM c.lang),
lex AS (
  SELECT DISTINCT lang, word FROM (
    SELECT d.lang, lower(regexp_replace(unnest(regexp_extract_all(d.text, '[a-zA-ZÀ-ÿ]+')), '[×÷]', '', 'g')) AS word
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.quality = 1 {where}) WHERE word <> ''
),
rules(cls, ord, suffix, ending) AS (VALUES {_rules_values()}),
tagged AS (SELECT lang, word, {_class_case(_tag_case('word'))} AS cls FROM counts),
cands AS (
  SELECT lang, word, 0 AS ord, word AS lemma FROM tagged
  UNION ALL
  SELECT t.lang, t.word, r.ord, left(t.word, length(t.word) - length(r.suffix)) || r.ending
  FROM tagged t JOIN rules r ON r.cls = t.cls AND ends_with(t.word, r.suffix)
),
best AS (
  SELECT c.lang, c.word, arg_min(c.lemma, (length(c.lemma), c.ord)) AS lemma
  FROM cands c JOIN lex x ON x.lang IS NOT DISTINCT FROM c.lang AND x.word = c.lemma
  GROUP BY c.lang, c.word
),
lemma_map AS (
  SELECT b.lang, b.word, b.lemma, coalesce(f.freq, 0.0::DOUBLE) AS freq
  FROM best b LEFT JOIN wfreq f ON f.lang IS NOT DISTINCT FROM b.lang AND f.word = b.lemma
  WHERE coalesce(f.freq, 0.0::DOUBLE) < {float(threshold)!r}
),
sents AS (
  SELECT user_id, submission_id, lang, paragraph_number,
         unnest(ss) AS sentence, unnest(range(len(ss)))::INTEGER AS sentence_number
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM paras)
),
toks AS (
  SELECT user_id, submission_id, lang, paragraph_number, sentence_number, sentence,
         unnest(ts) AS token, unnest(range(len(ts)))::INTEGER AS token_number
  FROM (SELECT *, regexp_extract_all(sentence, '[a-zA-ZÀ-ÿ]+') AS ts FROM sents)
),
words AS (
  SELECT *, lower(regexp_replace(token, '[×÷]', '', 'g')) AS word
  FROM toks
  WHERE NOT (regexp_matches(token, '^[A-ZÀ-ÖØ-Þ]') AND token_number > 0)
),
hits AS (
  SELECT w.*, m.lemma, m.freq FROM words w JOIN lemma_map m ON m.lang IS NOT DISTINCT FROM w.lang AND m.word = w.word
  WHERE w.word <> ''
),
agg AS (
  SELECT user_id, submission_id, lemma AS word, count(*) AS count,
         arg_min(sentence, (paragraph_number, sentence_number, token_number)) AS first_sentence,
         min(paragraph_number) AS first_paragraph,
         arg_min(sentence_number, (paragraph_number, sentence_number, token_number)) AS fs,
         arg_min(token_number, (paragraph_number, sentence_number, token_number)) AS ft,
         max(freq) AS language_frequency
  FROM hits GROUP BY user_id, submission_id, lemma
),
ranked AS (
  SELECT user_id, submission_id, word, count, first_sentence, first_paragraph, language_frequency,
         (row_number() OVER (PARTITION BY user_id, submission_id
                             ORDER BY language_frequency DESC, first_paragraph, fs, ft))::INTEGER AS rank
  FROM agg
)"""


def _with(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip() + "\n" + select


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def explode_list(keys: str, lst: str, src: str) -> str:
    """posexplode twin: one row per element with a 0-based INTEGER position."""
    return (f"SELECT {keys}, unnest(l) AS text, unnest(range(len(l)))::INTEGER AS paragraph_number "
            f"FROM (SELECT *, {lst} AS l FROM {src})")


CONV_CTE = """conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
                  FROM conversations GROUP BY conv_id)"""

P1 = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def p3(lst: str, min_length: int = 100) -> str:
    return f"list_filter(list_transform({lst}, lambda x: {clean('x')}), lambda x: length(x) >= {min_length})"


def p2(lst: str) -> str:
    return f"list_transform({lst}, lambda x: regexp_replace(x, '[\n\r]+', ' ', 'g'))"


# Written out here rather than imported, so that a wrong pattern in the library shows.
_ENTITY_TEXT = [("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&nbsp;", "chr(160)"),
                ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")]
_HTML_REST = r"""(?:=\s*(?:"[^"]*"|\x27[^\x27]*\x27)|[^>])*"""
_HTML_TAG = rf"<(?:/?[a-zA-Z]|[!?]){_HTML_REST}>"
_HTML_BLOCKS = ("address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|"
                "form|h1|h2|h3|h4|h5|h6|header|hgroup|hr|html|li|main|menu|nav|ol|pre|search|section|summary|table|td|th|tr|ul")


def _decode(x: str) -> str:
    for entity, char in _ENTITY_TEXT:
        x = f"replace({x}, '{entity}', {char})"
    return x


def _visible(x: str) -> str:
    return (f"regexp_replace({x}, '(?is)<script(?:[\\s/]{_HTML_REST})?>.*?</script\\s*>"
            f"|<style(?:[\\s/]{_HTML_REST})?>.*?</style\\s*>|<!--.*?-->', '', 'g')")


def _fragments(x: str) -> str:
    boundary = rf"(?i)</p\s*>|</?(?:{_HTML_BLOCKS})(?:[\s/]{_HTML_REST})?>"
    marked = f"regexp_replace(regexp_replace({x}, '{boundary}', chr(2), 'g'), '(?i)<p(?:[\\s/]{_HTML_REST})?>', chr(1), 'g')"
    return f"list_transform(string_split({marked}, chr(1))[2:], lambda f: split_part(f, chr(2), 1))"


def p4(x: str) -> str:
    untagged = f"regexp_replace(t, '{_HTML_TAG}', '', 'g')"
    return f"list_transform({_fragments(_visible(x))}, lambda t: {_decode(untagged)})"


def p5(inner: str) -> str:
    node = strip(_decode("n"))
    return (f"list_filter(list_transform({_fragments(inner)}, lambda t: array_to_string("
            f"list_transform(regexp_split_to_array(t, '{_HTML_TAG}'), lambda n: {node}), '')), lambda t: t <> '')")


def scope(x: str, element: str = "article") -> str:
    v = _visible(x)
    inner = rf"'(?is)<{element}\b[^>]*>(.*?)</{element}\s*>'"
    return (f"CASE WHEN regexp_matches({v}, {inner}) THEN regexp_extract({v}, {inner}, 1) "
            rf"ELSE regexp_extract({v}, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1) END")


LAYOUT_CTES = r"""
lwords AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents),
lblocks AS (
  SELECT doc_id, unnest(list_transform(range(0, greatest(ceil(len(w) / 12)::INTEGER, 1)),
                                       lambda i: array_to_string(w[i * 12 + 1 : i * 12 + 12], ' '))) AS text,
         unnest(range(0, greatest(ceil(len(w) / 12)::INTEGER, 1)))::INTEGER AS block_no
  FROM lwords
),
blocks AS (
  SELECT doc_id, [block_no // 3, block_no] AS path, 'paragraph' AS type, text,
         block_no // 3 AS page_start, block_no // 3 AS page_end FROM lblocks
),
body AS (
  SELECT doc_id, path, page_start, page_end, t AS text FROM (
    SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM blocks WHERE type = 'paragraph')
  WHERE length(t) > 40
    AND NOT (length(t) <= 80 AND regexp_matches(t, '[\p{Lu}\p{Lt}]') AND NOT regexp_matches(t, '\p{Ll}'))
)"""

STITCH_CTES = LAYOUT_CTES + r""",
flagged AS (
  SELECT doc_id, path, text,
         lag(text) OVER w IS NOT NULL AS has_prev,
         page_start IS DISTINCT FROM lag(page_end) OVER w AS top_of_page,
         coalesce(regexp_matches(lag(text) OVER w, '[\p{L}\p{N}_][—-]$'), false) AS prev_mid_word,
         coalesce(regexp_matches(lag(text) OVER w, '[a-z]$'), false) AS prev_mid_sentence
  FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY path)
),
joined AS (
  SELECT *, has_prev AND top_of_page AND regexp_matches(text, '^[a-z]')
            AND (prev_mid_word OR prev_mid_sentence) AS is_join FROM flagged
),
numbered AS (
  SELECT doc_id, path,
         CASE WHEN is_join AND NOT prev_mid_word THEN ' ' ELSE '' END || text AS piece,
         (sum(CASE WHEN is_join THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY path
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::INTEGER AS paragraph_number
  FROM joined
)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["vocabulary_report"] = _with(vocabulary_ctes(), "SELECT * FROM ranked")
    q["blank_line_split"] = _with(CONV_CTE, explode_list("conv_id AS submission_id", P1, "conv"))
    q["text_paragraphs"] = _with(CONV_CTE, explode_list("conv_id AS submission_id", p3(p2(P1)), "conv"))
    q["html_paragraphs"] = explode_list("page_id", p4("html"), "pages")
    q["html_clean_paragraphs"] = explode_list("page_id", p3(p2(p4("html"))), "pages")
    q["page_article_paragraphs"] = explode_list("page_id, url", p5(scope("html")), "pages")
    q["page_content_paragraphs"] = q["page_article_paragraphs"]
    q["page_navigation"] = r"""
WITH navs AS (SELECT page_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS nav FROM pages),
links AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(nav, '<a[^>]*>([^<]*)</a>', 1) AS texts FROM navs),
flat AS (SELECT page_id, unnest(range(len(hrefs)))::INTEGER AS link_number, unnest(hrefs) AS href, unnest(texts) AS text FROM links)
SELECT page_id, link_number, """ + f"{_decode('href')} AS href, {_decode('text')} AS text, " + r"""5 AS depth FROM flat"""
    q["layout_body_blocks"] = _with(LAYOUT_CTES, "SELECT doc_id, array_to_string(path, '.') AS path_key, "
                                    "text, page_start, page_end FROM body")
    q["cross_page_paragraphs"] = _with(STITCH_CTES, "SELECT doc_id, paragraph_number, "
                                       "string_agg(piece, '' ORDER BY path) AS text FROM numbered "
                                       "GROUP BY doc_id, paragraph_number")
    _summary_oracles(q)
    _keyed_oracles(q)
    _guide_oracles(q)
    q["streamed_stage_state"] = q["stage_state"]
    q["streamed_upload_keys"] = q["object_key_parse"]
    q["streamed_upload_rate"] = q["upload_rate"]
    q["streamed_stage_failures"] = """
SELECT user_id, event_id, ts, 'stage reported an error' AS reason FROM events WHERE event_type = 'error'"""
    q["streamed_study_guide"] = q["study_guide"]
    from lectern.plans.catalog import RUN_TS
    q["vocabulary_bulk_insert"] = _with(vocabulary_ctes(), "SELECT user_id, submission_id, "
                                        f"first_paragraph AS paragraph_number, word, rank, {RUN_TS}::BIGINT AS created_at "
                                        "FROM ranked")
    # The text writer ends every file with a newline.
    q["uploaded_text_files"] = explode_list(
        "source AS user_id, doc_id AS submission_id", p3(p2(P1.replace("text", "(text || chr(10))", 1))),
        "(SELECT * FROM documents WHERE text IS NOT NULL)")
    q["sentence_split"] = _with(doc_paragraphs_cte(), r"""
SELECT user_id, submission_id, lang, paragraph_number,
       unnest(ss) AS sentence, unnest(range(len(ss)))::INTEGER AS sentence_number
FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM paras)""")
    q["paragraph_token_counts"] = _with(vocabulary_ctes("") + """,
all_toks AS (
  SELECT user_id, submission_id, paragraph_number, lower(regexp_replace(token, '[×÷]', '', 'g')) AS word,
         (regexp_matches(token, '^[A-ZÀ-ÖØ-Þ]') AND token_number > 0) AS is_proper
  FROM toks
)""", """
SELECT user_id, submission_id, paragraph_number, count(*) AS tokens,
       count_if(NOT is_proper AND word <> '')::BIGINT AS kept_tokens,
       count(DISTINCT CASE WHEN NOT is_proper AND word <> '' THEN word END) AS distinct_words
FROM all_toks GROUP BY user_id, submission_id, paragraph_number""")
    q["threshold_lookup"] = _with(vocabulary_ctes("", 1e-4), """
SELECT user_id, submission_id, threshold, count(*) FILTER (WHERE language_frequency < threshold)::INTEGER AS words
FROM ranked, (SELECT unnest([1.3e-5, 2.7e-5, 8.1e-5]::DOUBLE[]) AS threshold) GROUP BY user_id, submission_id, threshold""")
    q["sliding_upload_rate"] = """
SELECT event_id, user_id, ts, uploads, uploads > 1 AS over_limit FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS uploads
  FROM events WHERE event_type = 'click')"""
    from lectern.plans import learned, live
    q.update(learned.oracle_sql())
    q.update(live.oracle_sql(q, _summary_ctes()))
    return q


# --------------------------------------------------------------------------
# Summarisation
# --------------------------------------------------------------------------

def lit(s: str) -> str:
    """A DuckDB string literal holding exactly ``s`` (newlines included)."""
    return "'" + s.replace("'", "''") + "'"


def _summary_ctes(with_paragraphs: bool = True) -> str:
    sentence1 = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"
    sep = lit("\n\n")
    return (doc_paragraphs_cte() if with_paragraphs else "") + f""",
q AS (
  SELECT user_id, submission_id, paragraph_number, text,
         row_number() OVER (PARTITION BY user_id, submission_id ORDER BY paragraph_number) - 1 AS rn
  FROM paras WHERE length({strip('text')}) >= 300
),
batches AS (
  SELECT user_id, submission_id, paragraph_number, text, (rn // 20)::INTEGER AS batch_no, (rn % 20 + 1)::INTEGER AS item_no FROM q
),
grouped AS (
  SELECT user_id, submission_id, batch_no, count(*)::INTEGER AS n_items,
         string_agg({lit(chr(10) * 2 + "---PARAGRAPH ")} || item_no || {lit("---" + chr(10))} || text, {sep} ORDER BY item_no) AS items,
         string_agg(paragraph_number::VARCHAR, ',' ORDER BY item_no) AS paragraph_numbers
  FROM batches GROUP BY user_id, submission_id, batch_no
),
prompts AS (
  SELECT user_id, submission_id, batch_no, n_items,
         {strip(lit("Summarise each of the ") + " || n_items || " + lit(" paragraphs below in one sentence." + chr(10) + "---" + chr(10) * 2)
                + " || items || " + lit(chr(10) * 2 + "---" + chr(10) * 2 + "Return exactly ") + " || n_items || "
                + lit(" summaries, one per paragraph, numbered as marked."))} AS user_prompt,
         'You help students who are learning English read assigned texts. Paragraphs are delimited by markers of the form '
         || '---PARAGRAPH n---. For each paragraph write exactly one plain sentence that keeps its key facts and claims '
         || 'and that an English learner can follow.' AS system_prompt,
         '{{"type":"json_schema","json_schema":{{"name":"paragraph_summaries","strict":true,"schema":{{"type":"object","properties":'
         || '{{"summaries":{{"type":"array","description":"' || n_items || ' one-sentence answers","items":{{"type":"object","properties":'
         || '{{"paragraph_number":{{"type":"integer"}},"summary":{{"type":"string"}}}},"required":["paragraph_number","summary"],'
         || '"additionalProperties":false}}}}}},"required":["summaries"],"additionalProperties":false}}}}}}' AS response_format,
         paragraph_numbers
  FROM grouped
),
verdicts AS (SELECT user_id, submission_id, batch_no, n_items, 'ok' AS status FROM grouped),
summary_rows AS (
  SELECT user_id, submission_id, paragraph_number,
         array_to_string(regexp_split_to_array({strip('text')}, '\\s+')[1:10], ' ') AS paragraph_start,
         CASE WHEN length({strip('text')}) >= 300 THEN {sentence1} ELSE text END AS summary
  FROM paras
)"""


def _summary_oracles(q: dict[str, str]) -> None:
    ctes = _summary_ctes()
    q["summary_batches"] = _with(ctes, "SELECT user_id, submission_id, paragraph_number, batch_no, item_no FROM batches")
    q["summary_prompts"] = _with(ctes, "SELECT * FROM prompts")
    q["summary_validation"] = _with(ctes, "SELECT * FROM verdicts")
    q["paragraph_summaries"] = _with(ctes, "SELECT * FROM summary_rows")
    q["capped_summaries"] = _with(ctes, "SELECT * FROM summary_rows WHERE paragraph_number <= 20")
    # M9: each paragraph alone -> qualifying ones get their first sentence.
    q["single_paragraph_summaries"] = _with(ctes, "SELECT user_id, submission_id, paragraph_number, summary FROM summary_rows")


# --------------------------------------------------------------------------
# Sources, keyed tables, read side
# --------------------------------------------------------------------------

def _list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def _case(expr: str, mapping: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) \
        + f" ELSE {lit(default)} END"


def _suffix(name: str) -> str:
    return f"lower(regexp_extract(string_split({name}, '/')[-1], '^.+(\\.[^./]+)$', 1))"


def _route(name: str) -> str:
    from lectern.sources.files import ROUTES
    return _case(_suffix(name), ROUTES, "unsupported")


def _uploads_cte(readable: bool = False) -> str:
    from lectern.sources.adapters import DOC_EXTENSIONS, READABLE_EXTENSIONS
    extensions = READABLE_EXTENSIONS if readable else DOC_EXTENSIONS
    return f"""uploads AS (
  SELECT source AS user_id, doc_id::VARCHAR AS submission_id,
         'doc_' || doc_id || {_list(extensions)}[doc_id % {len(extensions)} + 1] AS file_name, text AS content
  FROM documents
  UNION ALL
  SELECT 'web', 'p' || page_id, 'page_' || page_id || '.html', html FROM pages
)"""


def _requests_cte() -> str:
    from lectern.sources.adapters import DOC_EXTENSIONS, EPOCH_BASE, MISSING_NAME_EVERY
    m = MISSING_NAME_EVERY
    return f"""requests AS (
  SELECT doc_id, source AS user_id,
         CASE WHEN doc_id % {m} <> {m - 1}
              THEN 'doc_' || doc_id || {_list(DOC_EXTENSIONS)}[doc_id % {len(DOC_EXTENSIONS)} + 1] END AS file_name,
         sha256(text) AS file_hash, ({EPOCH_BASE} + doc_id * 60)::BIGINT AS requested_at, doc_id AS seq
  FROM documents
),
valid_requests AS (
  SELECT * FROM requests
  WHERE coalesce(user_id, '') <> '' AND coalesce(file_name, '') <> '' AND coalesce(file_hash, '') <> ''
),
registration AS (
  SELECT user_id, file_hash AS submission_id, 0 AS state,
         arg_max(file_name, (requested_at, seq)) AS filename,
         arg_max(requested_at, (requested_at, seq)) AS created_at,
         arg_max('uploads/' || user_id || '/' || file_hash
                 || regexp_extract(file_name, '^\\.*[^.].*(\\.[^.]*)$', 1), (requested_at, seq)) AS object_key
  FROM valid_requests GROUP BY user_id, file_hash
)"""


def _status(state: str) -> str:
    return (f"CASE WHEN {state} IS NULL THEN 'Invalid state' WHEN {state} = 0 THEN 'received' "
            f"WHEN {state} < 7 THEN 'processing' WHEN {state} = 7 THEN 'complete' ELSE {state}::VARCHAR END")


def _stage_bits_case() -> str:
    from lectern.sources.adapters import EVENT_STAGE_BITS
    return "CASE " + " ".join(f"WHEN event_type = {lit(t)} THEN {b}" for t, b in EVENT_STAGE_BITS.items()) + " END"


STAGE_STATE_SQL = f"""SELECT user_id, sum(bit)::BIGINT AS state_sum, bit_or(bit)::INTEGER AS state_mask
FROM (SELECT user_id, {{bits}} AS bit FROM events WHERE event_type <> 'error') GROUP BY user_id"""


def _mime(ext: str) -> str:
    from lectern.sources.adapters import EXTENSION_MIME
    return _case(ext, EXTENSION_MIME, "application/octet-stream")


def _icon(mime: str) -> str:
    from lectern.functions.labels import MIME_RULES
    parts = []
    for label, needles in MIME_RULES:
        cond = " OR ".join(f"contains({mime}, {lit(n)})" for n in needles)
        parts.append(f"WHEN {cond} THEN {lit(label)}")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


def _ui_accepts(name: str) -> str:
    from lectern.functions.labels import UI_ACCEPTED_EXTENSIONS
    return f"list_contains({_list(UI_ACCEPTED_EXTENSIONS)}, '.' || lower(string_split({name}, '.')[-1]))"


def _keyed_oracles(q: dict[str, str]) -> None:
    q["content_hash"] = "SELECT source AS user_id, doc_id, sha256(text) AS submission_id FROM documents"
    routed = f"SELECT *, {_route('file_name')} AS route FROM uploads"
    q["format_routing"] = _with(_uploads_cte(), f"""
SELECT user_id, submission_id, file_name, route,
       CASE WHEN route IN ('text', 'html', 'pdf') THEN NULL
            WHEN route = 'unsupported' THEN 'unsupported file type: ' || file_name
            ELSE 'no extractor for route ' || route END AS reason
FROM ({routed})""")
    q["rejected_formats"] = _with(_uploads_cte(), f"""
SELECT user_id, submission_id, file_name, route,
       CASE WHEN route = 'unsupported' THEN 'unsupported file type: ' || file_name ELSE 'no extractor for route ' || route END AS reason
FROM ({routed}) WHERE route NOT IN ('text', 'html', 'pdf')""")
    q["undecodable_messages"] = """
SELECT event_id, 'enveloped message is not JSON' AS reason FROM events WHERE event_id % 2 = 0 AND event_type = 'signup'"""
    q["extract_paragraphs"] = _with(STITCH_CTES + ",\n" + _uploads_cte(True) + f""",
routed AS ({routed}),
stitched AS (
  SELECT doc_id, paragraph_number, string_agg(piece, '' ORDER BY path) AS text
  FROM numbered GROUP BY doc_id, paragraph_number
),
pdf_docs AS (SELECT user_id, submission_id FROM routed WHERE route = 'pdf'),
pdf_clean AS (
  SELECT p.user_id, p.submission_id, s.paragraph_number, {clean("regexp_replace(s.text, '[\\n\\r]+', ' ', 'g')")} AS text
  FROM stitched s JOIN pdf_docs p ON p.submission_id = s.doc_id::VARCHAR
)""", f"""
{explode_list("user_id, submission_id", p3(p2(P1.replace("text", "content"))), "(SELECT * FROM routed WHERE route = 'text')")}
UNION ALL
{explode_list("user_id, submission_id", p3(p2(p4("content"))), "(SELECT * FROM routed WHERE route = 'html')")}
UNION ALL
SELECT user_id, submission_id, text,
       (row_number() OVER (PARTITION BY user_id, submission_id ORDER BY paragraph_number) - 1)::INTEGER
FROM pdf_clean WHERE length(text) >= 100""")
    q["object_key_parse"] = r"""
SELECT event_id, 'uploads-bucket' AS bucket, key,
       CASE WHEN ok THEN parts[2] END AS user_id,
       CASE WHEN ok THEN regexp_replace(parts[3], '^(\.*[^.].*)\.[^.]*$', '\1') END AS submission_id,
       CASE WHEN NOT ok THEN 'invalid object key: ' || key END AS reason
FROM (
  SELECT event_id, key, string_split(key, '/') AS parts,
         len(string_split(key, '/')) >= 3 AND string_split(key, '/')[1] = 'uploads' AS ok
  FROM (SELECT event_id,
               CASE WHEN event_type = 'error' THEN 'incoming/' || event_id
                    ELSE 'uploads/u' || user_id || '/' || sha256(event_id::VARCHAR) || '.txt' END AS key
        FROM events WHERE event_type IN ('click', 'error')))"""
    q["paragraph_json"] = _with(doc_paragraphs_cte(), """
SELECT user_id, submission_id, to_json(list(text ORDER BY paragraph_number))::VARCHAR AS paragraphs_json
FROM paras GROUP BY user_id, submission_id""")
    q["paragraph_json_roundtrip"] = _with(doc_paragraphs_cte(),
                                          "SELECT user_id, submission_id, paragraph_number, text FROM paras")
    q["upload_registration"] = _with(_requests_cte(), "SELECT * FROM registration")
    q["rejected_uploads"] = _with(_requests_cte(), """
SELECT user_id, file_hash, requested_at, 'user, file name or hash is missing' AS reason
FROM requests WHERE NOT (coalesce(user_id, '') <> '' AND coalesce(file_name, '') <> '' AND coalesce(file_hash, '') <> '')""")
    q["input_gate"] = """
SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN strlen(text)::BIGINT END AS n_bytes,
       CASE WHEN coalesce(text, '') = '' THEN 400
            WHEN strlen(text) > 16384 OR length(text) > 200000 THEN 413 ELSE 200 END AS status,
       CASE WHEN coalesce(text, '') = '' THEN 'nothing to read'
            WHEN strlen(text) > 16384 OR length(text) > 200000 THEN 'too large' END AS reason
FROM documents"""
    keys = "SELECT user_id, submission_id, paragraph_number, 'SUMMARY#' || submission_id || '#' || paragraph_number AS sort_key FROM paras"
    q["summary_keys"] = _with(doc_paragraphs_cte(), keys)
    first = "regexp_split_to_array(" + strip("text") + ", '\\s+')[1]"
    q["vocabulary_key_decode"] = f"""
SELECT sort_key, parts[2] AS submission_id, CASE WHEN reason IS NULL THEN num END AS paragraph_number, reason,
       CASE WHEN reason IS NULL THEN parts[4] END AS word
FROM (
  SELECT sort_key, parts, TRY_CAST(parts[3] AS INTEGER) AS num,
         CASE WHEN len(parts) <> 4 THEN 'expected 4 parts'
              WHEN TRY_CAST(parts[3] AS INTEGER) IS NULL THEN 'paragraph number is not an integer' END AS reason
  FROM (SELECT sort_key, string_split(sort_key, '#') AS parts FROM (
    SELECT 'VOCAB#p' || page_id || '#' || paragraph_number || '#' || {first} AS sort_key
    FROM ({explode_list("page_id", p4("html"), "pages")}))))"""
    q["submission_lookup"] = _with(_requests_cte(), """
SELECT r.user_id, r.submission_id, t.state, t.filename, t.submission_id IS NOT NULL AS found
FROM (SELECT DISTINCT user_id, submission_id FROM (
        SELECT source AS user_id, sha256(text) AS submission_id FROM documents
        UNION ALL SELECT role, sha256(text) FROM conversations)) r
LEFT JOIN registration t USING (user_id, submission_id)""")
    q["user_submissions"] = _with(_requests_cte(), "SELECT * FROM registration WHERE user_id = 'src3'")
    q["summary_key_scan"] = _with(doc_paragraphs_cte(), f"""
SELECT *, row_number() OVER (PARTITION BY user_id, submission_id ORDER BY sort_key)::INTEGER AS scan_position
FROM ({keys})""")
    q["submissions_by_filename"] = _with(_requests_cte(),
                                         "SELECT * FROM registration WHERE user_id = 'src7' AND filename = 'doc_7.xlsx'")
    q["delete_toxic"] = _with(_requests_cte(), """
SELECT * FROM registration t WHERE NOT EXISTS (
  SELECT 1 FROM requests r JOIN labels l ON l.doc_id = r.doc_id
  WHERE l.toxic = 1 AND r.user_id = t.user_id AND r.file_hash = t.submission_id)""")
    stage = STAGE_STATE_SQL.format(bits=_stage_bits_case())
    q["stage_state"] = stage
    q["paragraph_counts"] = f"""
SELECT source AS user_id, doc_id AS submission_id, 0 AS state,
       len({p3("string_split(text, chr(10))")})::INTEGER AS paragraph_count
FROM documents"""
    days = f"""day_reports AS (
  SELECT DISTINCT user_id, CAST(ts AS DATE)::VARCHAR AS submission_id, {_stage_bits_case()} AS bit
  FROM events WHERE event_type <> 'error'
),
day_state AS (SELECT user_id, submission_id, sum(bit)::BIGINT AS state_sum FROM day_reports GROUP BY user_id, submission_id)"""
    q["submission_status"] = _with(days, f"SELECT user_id, submission_id, state_sum, {_status('state_sum')} AS status FROM day_state")
    q["redelivered_status"] = f"SELECT user_id, state_sum, {_status('state_sum')} AS status FROM ({stage})"
    q["submission_listing"] = _with(days + """,
day_first AS (
  SELECT user_id, CAST(ts AS DATE)::VARCHAR AS submission_id, min(event_id) FILTER (WHERE event_type = 'view') AS view,
         min(epoch(ts))::BIGINT AS created_at
  FROM (SELECT user_id, event_id, event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL
)""", f"""
SELECT s.user_id, s.submission_id AS id, coalesce('upload_' || f.view || '.txt', 'Unnamed Document') AS filename, f.created_at,
       {_status('s.state_sum')} AS status, make_timestamp(f.created_at * 1000000)::DATE AS created_date,
       {_status('s.state_sum')} = 'complete' AS details_link
FROM day_state s JOIN day_first f USING (user_id, submission_id)""")
    q["document_sizes"] = """
SELECT doc_id, n AS n_bytes,
       CASE WHEN n = 0 THEN '0 Bytes'
            ELSE regexp_replace(round(n / pow(1024, i), 2)::VARCHAR, '\\.0$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][i + 1] END
         AS size_label
FROM (SELECT doc_id, n, least(floor(ln(n::DOUBLE) / ln(1024.0))::INTEGER, 3) AS i
      FROM (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents))"""
    types = (f"SELECT user_id, submission_id, file_name, mime, {_icon('mime')} AS icon, "
             f"{_ui_accepts('file_name')} AS ui_accepts, {_route('file_name')} AS route "
             f"FROM (SELECT *, {_mime(_suffix('file_name'))} AS mime FROM uploads)")
    q["upload_types"] = _with(_uploads_cte(), types)
    q["type_acceptance_gaps"] = _with(_uploads_cte() + f",\nt AS (SELECT {_suffix('file_name')} AS ext, * FROM ({types}))", """
SELECT ext, 'form only' AS gap FROM (
  SELECT ext FROM t WHERE ui_accepts EXCEPT SELECT ext FROM t WHERE route IN ('text', 'html', 'pdf', 'docx', 'rtf'))
UNION ALL
SELECT ext, 'service only' FROM (
  SELECT ext FROM t WHERE route IN ('text', 'html', 'pdf', 'docx', 'rtf') EXCEPT SELECT ext FROM t WHERE ui_accepts)""")
    q["word_definitions"] = """
SELECT p_partkey AS word_id, p_name AS word, d AS definition, lower(p_type) AS "partOfSpeech"
FROM (SELECT *, unnest(['A ' || p_name || '.', '', 'Kind of ' || string_split(p_name, ' ')[2] || '.']) AS d
      FROM part WHERE NOT coalesce(p_size > 45, false))
WHERE d IS NOT NULL AND d <> ''"""
    q["submission_text"] = _with(doc_paragraphs_cte(), """
SELECT user_id, submission_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_number) AS text
FROM paras GROUP BY user_id, submission_id""")
    q["paragraph_display"] = _with(_summary_ctes(), """
SELECT s.user_id, s.submission_id, s.paragraph_number, s.paragraph_start || '...' AS collapsed,
       coalesce(p.text, s.paragraph_start || '...') AS expanded
FROM summary_rows s LEFT JOIN paras p USING (user_id, submission_id, paragraph_number)""")


# --------------------------------------------------------------------------
# Vocabulary stages, study guide, product features
# --------------------------------------------------------------------------

def _guide_ctes() -> str:
    return vocabulary_ctes("") + _summary_ctes(with_paragraphs=False) + """,
gwords AS (
  SELECT user_id, submission_id, first_paragraph AS paragraph_index,
         list(word ORDER BY 'VOCAB#' || submission_id || '#' || first_paragraph || '#' || word) AS vocabulary
  FROM ranked GROUP BY user_id, submission_id, first_paragraph
),
gidx AS (
  SELECT user_id, submission_id, unnest(range(max(i) + 1))::INTEGER AS paragraph_index
  FROM (SELECT user_id, submission_id, paragraph_index AS i FROM gwords
        UNION ALL SELECT user_id, submission_id, paragraph_number FROM summary_rows) GROUP BY user_id, submission_id
),
guide AS (
  SELECT i.user_id, i.submission_id, i.paragraph_index, coalesce(w.vocabulary, []::VARCHAR[]) AS vocabulary,
         coalesce(s.summary, '') AS summary, coalesce(s.paragraph_start, '') AS paragraph_start
  FROM gidx i LEFT JOIN gwords w USING (user_id, submission_id, paragraph_index)
  LEFT JOIN summary_rows s ON s.user_id = i.user_id AND s.submission_id = i.submission_id AND s.paragraph_number = i.paragraph_index
)"""


def _guide_oracles(q: dict[str, str]) -> None:
    from lectern.operators.product import threshold_column
    from lectern.plans.catalog import THRESHOLDS
    q["word_frequency_table"] = _with(vocabulary_ctes(""),
                                      "SELECT c.lang, c.word, c.n, f.freq FROM counts c JOIN wfreq f ON f.lang IS NOT DISTINCT FROM c.lang AND f.word = c.word")
    q["lemma_table"] = _with(vocabulary_ctes(""), "SELECT lang, word, lemma FROM best")
    q["vocabulary_all_languages"] = _with(vocabulary_ctes("", 2e-4), "SELECT * FROM ranked")
    q["vocabulary_table"] = _with(vocabulary_ctes(), "SELECT user_id, submission_id, "
                                  "first_paragraph AS paragraph_number, word, rank FROM ranked")
    q["study_guide"] = _with(_guide_ctes(), "SELECT user_id, submission_id, paragraph_index, "
                             "array_to_string(vocabulary, ' ') AS vocabulary, summary, paragraph_start FROM guide")
    nl2 = "chr(10) || chr(10)"
    q["guide_markdown"] = _with(_guide_ctes(), f"""
SELECT user_id, submission_id,
       string_agg('## ' || paragraph_start || '...' || {nl2} || summary
                  || CASE WHEN len(vocabulary) > 0 THEN {nl2} || '**Vocabulary:** ' || array_to_string(vocabulary, ', ')
                          ELSE '' END, {nl2} ORDER BY paragraph_index) AS markdown
FROM guide GROUP BY user_id, submission_id""")
    q["duplicate_submissions"] = """
SELECT user_id, submission_id, doc_id, created_at,
       count(*) OVER (PARTITION BY user_id, submission_id) AS copies,
       row_number() OVER (PARTITION BY user_id, submission_id ORDER BY created_at, doc_id) > 1 AS is_duplicate
FROM (SELECT source AS user_id, doc_id, sha256(text) AS submission_id,
             (1700000000 + doc_id * 60)::BIGINT AS created_at FROM documents)"""
    q["upload_rate"] = """
SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS uploads,
       count(*) > 10 AS over_limit
FROM events WHERE event_type = 'click' GROUP BY user_id, time_bucket(INTERVAL '1 minute', ts)"""
    cols = ", ".join(f"count_if(language_frequency < {t!r})::BIGINT AS {threshold_column(t)}"
                     for t in sorted(THRESHOLDS))
    q["threshold_profile"] = _with(vocabulary_ctes("", max(THRESHOLDS)),
                                   f"SELECT user_id, submission_id, {cols} FROM ranked GROUP BY user_id, submission_id")
    q["recent_submissions"] = _with(_requests_cte(), """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(created_at, 0) DESC, submission_id)::INTEGER
         AS position FROM registration) WHERE position <= 5""")
    q["resume_stages"] = f"""
WITH done AS (SELECT user_id, CAST(ts AS DATE)::VARCHAR AS submission_id, {_stage_bits_case()} AS bit FROM events WHERE event_type <> 'error'),
wanted AS (SELECT user_id, submission_id, unnest([1, 2, 4]) AS stage FROM (SELECT DISTINCT user_id, submission_id FROM done))
SELECT w.user_id, w.submission_id, w.stage FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = w.user_id AND d.submission_id = w.submission_id AND d.bit = w.stage)"""
    q["busy_days"] = """
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS uploads, count(*) > 2 AS over_limit
FROM events WHERE event_type = 'click' GROUP BY user_id, date_trunc('day', ts)"""
    marks = """,
words_v AS (SELECT user_id, submission_id, first_paragraph AS paragraph_number, word, rank FROM ranked),
marked AS (
  SELECT w.user_id, w.word, e.ts, ['known', 'learned', 'not interested'][e.event_id % 3 + 1] AS mark
  FROM events e JOIN words_v w ON w.submission_id = e.user_id AND w.rank = e.event_id % 5 + 1
),
latest AS (SELECT user_id, word, arg_max(mark, (ts, mark)) AS mark FROM marked GROUP BY user_id, word),
with_mark AS (SELECT w.*, coalesce(l.mark, 'unmarked') AS mark FROM words_v w LEFT JOIN latest l USING (user_id, word))"""
    q["word_marks"] = _with(vocabulary_ctes("") + marks, "SELECT * FROM with_mark")
    q["unknown_words"] = _with(vocabulary_ctes("") + marks, "SELECT * FROM with_mark WHERE mark <> 'known'")
    q["renamed_submissions"] = _with(_requests_cte(), """
SELECT r.user_id, r.submission_id, r.state, coalesce(n.filename, r.filename) AS filename, r.created_at, r.object_key
FROM registration r LEFT JOIN (
  SELECT d.source AS user_id, sha256(d.text) AS submission_id,
         arg_max('renamed_' || e.event_id || '.txt', (e.ts, 'renamed_' || e.event_id || '.txt')) AS filename
  FROM events e JOIN documents d ON d.doc_id = e.user_id WHERE e.event_type = 'view' GROUP BY ALL) n USING (user_id, submission_id)""")

"""The corpus operators in SQL, as far as SQL can say them, for comparison on the test tables.

Hash-drawn coins, shards, fingerprints, tokenizers and trained models are beyond it.  Of operators that use them,
companion queries show what SQL can check: targets, sizes, balance, exact neighbours.
"""

from __future__ import annotations

from weft.llm import quality

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Counts and base verdicts as of the quality operator.
_COUNTS = rf"""
base AS (SELECT doc_id, lang, coalesce(text, '') t, {_WORDS} w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM base)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest(range(i, i + 5)) j FROM repeated) GROUP BY 1),
lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM base),
counts AS (
  SELECT doc_id, lang, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
    len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words,
    len(w) < {quality.MIN_WORDS} OR 100 * coalesce(n, 0) > {quality.MAX_REPEATED_PERCENT} * len(w) base_failed
  FROM base JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id))"""


def quality_rules(alpha: float = 0.05, delta: float = 0.05) -> str:
    """Base verdicts, then cutoffs certified by the sum of the binomial's terms."""
    rules = quality.RULES
    share = alpha / len(rules)
    reach = ", ".join(f"struct_pack(rule := '{r}', depth := {' + '.join(f'({of} >= {c})::INT' for c in cuts)})" for r, (of, cuts) in rules.items())
    grid = ", ".join(f"('{r}', {place}, {c}, {len(cuts)})" for r, (_, cuts) in rules.items() for place, c in enumerate(cuts))
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share}))"
    hits = [f"CASE WHEN {of} >= (SELECT cutoff FROM best WHERE best.stratum IS NOT DISTINCT FROM lang AND rule = '{r}') THEN '{r}' END" for r, (of, _) in rules.items()]
    return f"""
WITH {_COUNTS},
known AS (SELECT doc_id, min(quality) q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
held AS (SELECT lang stratum, q, unnest([{reach}]) x FROM counts JOIN known USING (doc_id) WHERE NOT base_failed),
depths AS (SELECT stratum, x.rule rule, x.depth depth, count(*) FILTER (q = 1) good, count(*) FILTER (q <> 1) bad FROM held GROUP BY ALL),
grid(rule, place, cutoff, size) AS (VALUES {grid}),
tests AS (
  SELECT stratum, rule, place, cutoff, (sum(good))::BIGINT n, (sum(good) FILTER (depth >= size - place))::BIGINT k, sum(bad) FILTER (depth >= size - place) bad
  FROM depths JOIN grid USING (rule) GROUP BY ALL),
judged AS (
  SELECT *, CASE WHEN coalesce(k, 0) <= n * {share} THEN list_sum(list_transform(range(0, coalesce(k, 0) + 1), lambda j: {term})) ELSE 1 END
    <= {delta} / ((SELECT count(DISTINCT coalesce(stratum, '(null)')) FROM depths) * {len(rules)}) passed, coalesce(bad, 0) - {quality.PRICE} * coalesce(k, 0) gain
  FROM tests),
stops AS (SELECT stratum, rule, min(place) FILTER (NOT passed) stop FROM judged GROUP BY ALL),
best AS (
  SELECT j.stratum, j.rule, arg_max(cutoff, struct_pack(gain := gain, lenient := -place)) cutoff
  FROM judged j JOIN stops s ON j.stratum IS NOT DISTINCT FROM s.stratum AND j.rule = s.rule WHERE gain > 0 AND (stop IS NULL OR place < stop) GROUP BY ALL),
verdicts AS (SELECT *, CASE WHEN base_failed THEN '' ELSE concat_ws(',', {', '.join(hits)}) END rejected_by FROM counts)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  base_failed, NOT base_failed AND rejected_by = '' kept, rejected_by FROM verdicts"""


#: Every 200-byte string of the corpus, in hexadecimal digits; starts of one that occurs twice, joined to runs.
REPEATED_PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
pieces AS (SELECT doc_id, b, substr(h, 2 * b + 1, 1398) p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 500)) b FROM d WHERE length(h) >= 400)),
starts AS (SELECT doc_id, b + k i, md5(substr(p, 2 * k + 1, 400)) w FROM (SELECT doc_id, b, p, unnest(range(0, least(500, length(p) // 2 - 199))) k FROM pieces)),
often AS (SELECT w FROM starts GROUP BY 1 HAVING count(*) > 1),
twice AS (SELECT doc_id, i FROM starts SEMI JOIN often USING (w)),
begun AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true)::INT new FROM twice),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM begun),
runs AS (SELECT doc_id, run, min(i) a, max(i) + 200 z FROM numbered GROUP BY ALL),
kept AS (SELECT doc_id, h, a, z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0))) part FROM runs JOIN d USING (doc_id)),
cut AS (SELECT doc_id, sum(z - a) n_removed, count(*) n_spans, string_agg(part, '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) rest FROM kept GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(rest, h))) kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

#: The test pages' articles are marked by their element, so plain patterns find them.
MAIN_TEXT = r"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '(?s)<script.*?</script>|<style.*?</style>|<form.*?</form>|<aside.*?</aside>|<!--.*?-->', '', 'g') a FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), '<br ?/?>', ' ', 'g'), '</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>', chr(10), 'g'), chr(10)) parts FROM p),
t AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(html_unescaped(regexp_replace(x, '<[^>]*>', '', 'g')), '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> '') ls FROM b)
SELECT page_id, url, array_to_string(ls, chr(10)) AS text, length(array_to_string(ls, chr(10)))::BIGINT n_chars FROM t"""
# character references of the test pages, the ampersand's last
_PLAIN = "regexp_replace(x, '<[^>]*>', '', 'g')"
for _name, _char in (("nbsp", " "), ("middot", "·"), ("copy", "©"), ("mdash", "—"), ("hellip", "…"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_char}')"
MAIN_TEXT = MAIN_TEXT.replace("html_unescaped(regexp_replace(x, '<[^>]*>', '', 'g'))", _PLAIN)

_SIZES = f"SELECT doc_id, source, len({_WORDS})::BIGINT size FROM documents"

#: Targets by the level at which the sources' targets, capped at twice their sizes, add up to one and a half of all words.
MIX_TARGETS = f"""
WITH sized AS ({_SIZES}),
per AS (SELECT source, sum(size)::BIGINT source_size, list_extract([5.0, 2.0, 1.0], (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT)::DOUBLE weight FROM sized GROUP BY 1),
rooms AS (SELECT *, 2.0::DOUBLE * source_size most, 2.0::DOUBLE * source_size / weight room FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM rooms),
found AS (SELECT arg_min(lvl, struct_pack(room := room, source := source)) AS lvl FROM levels WHERE lvl <= room)
SELECT doc_id, size, source_size, round(coalesce(least(most, (SELECT lvl FROM found) * weight), most), 6) target
FROM sized s JOIN rooms r ON s.source IS NOT DISTINCT FROM r.source"""

SHARD_BALANCE = "SELECT count(*) docs, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT bytes, 8::BIGINT shards, true near_equal, true gapless FROM documents"

#: All pairs of a query and a candidate.
EXACT_NEIGHBOURS = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] v, row_number() OVER () r FROM embeddings WHERE embedding IS NOT NULL),
scored AS (SELECT a.vec_id query_id, a.r, b.vec_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 9) score FROM ranked WHERE rank <= 5"""

"""The same questions in SQL, for the operators that SQL can express."""

from __future__ import annotations

from .mixing import DIGITS, Mix
from .phrases import Mining
from .quality_rules import CUTOFFS, Risk
from .urls import RULES, Prior

#: Words between ASCII white space, A-Z lower-cased. DuckDB's lower() knows more letters, so translate() does it.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+')".format(upper=UPPER, lower=LOWER)

NEAR_DUPLICATES = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles
  FROM worded),
flat AS (SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 75 * (a.size + b.size - count(*))),
reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON l.node = s.doc_id
"""


_PRIOR = Prior()


def _shrunk(level: str, parent: str | None) -> str:
    """A level's groups with the beta posterior under their parent's mean."""
    keys = f"b.{level}" + (f", b.{parent}" if parent else "")
    mean = "p.mean" if parent else "(SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) FROM base)"
    source = f"base b JOIN {parent}_post p ON p.{parent} = b.{parent}" if parent else "base b"
    return f"""
{level}_sum AS (SELECT {keys}, sum(b.n)::DOUBLE AS n, sum(b.k)::DOUBLE AS k, min({mean}) AS m FROM {source} GROUP BY {keys}),
{level}_weight AS (
  SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0
      THEN (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) ELSE 0.0 END, {_PRIOR.least}), {_PRIOR.most}) - 1 AS w
  FROM {level}_sum),
{level}_post AS (SELECT s.*, k + w * m AS alpha, n - k + w * (1 - m) AS beta, (k + w * m) / (n + w) AS mean FROM {level}_sum s, {level}_weight)"""


def _rule() -> str:
    whens = []
    for rule, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        at, _, begin = rule.partition("/")
        whens.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{begin}') THEN '{rule}'")
    return "CASE " + " ".join(whens) + " END"


HOST_REPUTATION = f"""
WITH cut AS (SELECT page_id, url, strpos(url, '://') AS mark FROM pages),
split AS (
  SELECT page_id, CASE WHEN mark > 0 THEN translate(regexp_extract(url[mark + 3:], '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(url[mark + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS faulty FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
outcomes AS (
  SELECT s.page_id, m.faulty FROM split s JOIN marks m ON m.doc_id = try_cast(regexp_extract(s.path, '/([0-9]{{1,18}})(?:\\.html|/)?$', 1) AS BIGINT)),
base AS (
  SELECT s.host, array_to_string(list_reverse(list_reverse(string_split(s.host, '.'))[1:2]), '.') AS domain, string_split(s.host, '.')[-1] AS suffix,
    count(o.faulty)::DOUBLE AS n, coalesce(sum(o.faulty), 0)::DOUBLE AS k
  FROM split s LEFT JOIN outcomes o ON o.page_id = s.page_id GROUP BY s.host),
{_shrunk("suffix", None)},{_shrunk("domain", "suffix")},{_shrunk("host", "domain")},
ruled AS (
  SELECT s.page_id, s.host, s.path, {_rule().replace("host", "s.host").replace("path", "s.path")} AS rule,
    1 / (1 + exp(-(ln(p.alpha / p.beta) - {_PRIOR.z} * sqrt(1 / p.alpha + 1 / p.beta)))) AS bound
  FROM split s JOIN host_post p ON p.host = s.host)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)} WHEN bound > {_PRIOR.worst} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

_VALUES = {
    "symbols": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END",
    "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END",
    "repeats": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END",
    "long_words": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END",
    "short_words": "-(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END)",
}
_GRID = ", ".join(f"('{name}', {place}, CAST({cut} AS DOUBLE))" for name, cuts in CUTOFFS.items() for place, cut in enumerate(cuts))
_RISK = Risk()
_P = f"({_RISK.rate} / {len(_VALUES)})"
_TAIL = f"list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P})) FOR i IN range(0, k + 1)])"

CONTROLLED_RULES = rf"""
WITH worded AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM worded, unnest(range(1, len(words) - 6)) AS r(i)),
twice AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows JOIN twice USING (doc_id, w), unnest(range(0, 8)) AS r(j) GROUP BY doc_id),
stats AS (
  SELECT d.doc_id, d.lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
marked AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
each AS ({" UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{name}' AS rule, {value} AS value FROM marked" for name, value in _VALUES.items())}),
grid(rule, place, cutoff) AS (VALUES {_GRID}),
tried AS (
  SELECT e.lang, e.rule, g.place, g.cutoff, count(*) AS n, count(*) FILTER (e.value > g.cutoff) AS k
  FROM each e JOIN grid g ON g.rule = e.rule WHERE NOT e.base_failed AND e.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  GROUP BY e.lang, e.rule, g.place, g.cutoff),
passed AS (
  SELECT *, CASE WHEN k > n * {_P} THEN FALSE ELSE {_TAIL} <= {_RISK.doubt} / ({len(_VALUES)} * (SELECT count(DISTINCT coalesce(lang, '?')) FROM tried)) END AS ok FROM tried),
proven AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY place) AS all_ok FROM passed),
cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM proven WHERE all_ok GROUP BY lang, rule),
rejected AS (SELECT DISTINCT e.doc_id FROM each e JOIN cuts c ON c.lang IS NOT DISTINCT FROM e.lang AND c.rule = e.rule AND e.value > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM marked
"""

WARC_ROUND_TRIP = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digested AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS bytes, sha1(payload) AS hex FROM paid),
named AS (
  SELECT page_id, bytes, array_to_string([
      array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || hex[g * 5 + 1:g * 5 + 5] AS BIGINT) >> s) & 31) + 1] FOR s IN [15, 10, 5, 0]], '')
      FOR g IN range(0, 8)], '') AS digest FROM digested),
firsts AS (SELECT digest, bytes, max(page_id) AS original FROM named GROUP BY digest, bytes)
SELECT n.page_id, n.bytes AS payload_bytes, n.digest AS payload_digest,
  CASE WHEN n.page_id = f.original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n.page_id <> f.original THEN f.original END AS refers_to
FROM named n JOIN firsts f ON f.digest = n.digest AND f.bytes = n.bytes
"""

_LETTERED = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK_HITS = f"""
WITH worded AS (SELECT doc_id, {_LETTERED} AS words FROM documents),
items AS (SELECT item_id, {_LETTERED} AS words FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS w
  FROM items, unnest(range(1, greatest(len(words) - 8, 2))) AS r(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (
  SELECT doc_id, i, s.size, array_to_string(words[i:i + s.size - 1], ' ') AS w FROM worded, sizes s, unnest(range(1, len(words) - s.size + 2)) AS r(i)),
found AS (SELECT n.doc_id, n.i, n.size, g.item_id FROM windows n JOIN grams g ON g.w = n.w AND g.size = n.size),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM found, unnest(range(0, size)) AS r(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM worded d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

_MINING = Mining()

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
flat AS MATERIALIZED (
  SELECT lang, unnest(words) AS w1, unnest(list_concat(words[2:], [NULL])) AS w2, unnest(list_concat(words[3:], [NULL, NULL])) AS w3 FROM worded WHERE len(words) > 0),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, NULL AS w1, NULL AS w2, NULL AS w3, 1 AS size, count(*) AS a FROM flat GROUP BY lang, w1
  UNION ALL SELECT lang, w1 || ' ' || w2, w1, w2, NULL, 2, count(*) FROM flat WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {_MINING.least}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, 3, count(*) FROM flat WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {_MINING.least}),
halves AS (
  SELECT lang, phrase, a, 1 AS k, w1 AS head, CASE WHEN size = 2 THEN w2 ELSE w2 || ' ' || w3 END AS tail FROM f WHERE size > 1
  UNION ALL SELECT lang, phrase, a, 2, w1 || ' ' || w2, w3 FROM f WHERE size = 3),
cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, ({_MINING.scale} * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM halves c JOIN f l ON l.lang || chr(10) || l.phrase = c.lang || chr(10) || c.head JOIN f r ON r.lang || chr(10) || r.phrase = c.lang || chr(10) || c.tail),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f WHERE size = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f WHERE size = 3) GROUP BY lang, phrase),
phrases AS (
  SELECT x.* FROM least x LEFT JOIN covers c ON c.lang = x.lang AND c.phrase = x.phrase WHERE c.a IS NULL OR 100 * c.a < {_MINING.percent} * x.a)
SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, p.phrase) AS rank, p.phrase, p.a, p.l, p.r, t.n, CAST(p.score AS BIGINT) AS score
FROM phrases p JOIN totals t ON t.lang = p.lang
QUALIFY rank <= {_MINING.best}
"""

_MIX = Mix()

#: The same thresholds by sorting: a document is taken once more if its place in the order of (hash, size) lies before its source's budget.
SOURCE_MIX = f"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || left(md5('{_MIX.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), {DIGITS}) AS BIGINT) AS hash
  FROM documents),
sources AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, _MIX.weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_MIX.weights)} + 1] AS weight
  FROM sized GROUP BY source),
shared AS (
  SELECT 0 AS round, CAST(sum(source_size) AS HUGEINT) AS rest, CAST(sum(weight) AS HUGEINT) AS weights FROM sources
  UNION ALL
  SELECT s.round + 1, t.everything - t.held, t.open FROM shared s, LATERAL (
    SELECT sum(source_size) AS everything, coalesce(sum({_MIX.most} * source_size) FILTER ({_MIX.most} * source_size * s.weights < s.rest * weight), 0) AS held,
      coalesce(sum(weight) FILTER ({_MIX.most} * source_size * s.weights >= s.rest * weight), 0) AS open FROM sources) t
  WHERE (t.everything - t.held, t.open) <> (s.rest, s.weights)),
goals AS MATERIALIZED (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS copies FROM (
    SELECT s.*, CASE WHEN {_MIX.most} * source_size * r.weights < r.rest * weight THEN CAST({_MIX.most} * source_size AS DOUBLE)
      WHEN r.weights > 0 THEN CAST(r.rest * weight AS DOUBLE) / CAST(r.weights AS DOUBLE) ELSE 0.0 END AS target
    FROM sources s, (SELECT * FROM shared ORDER BY round DESC LIMIT 1) r)),
equal AS MATERIALIZED (
  SELECT *, CAST(sum(n * size) OVER (PARTITION BY source ORDER BY hash, size) - n * size AS BIGINT) AS below FROM (
    SELECT source, hash, size, count(*) AS n FROM sized GROUP BY source, hash, size)),
taken AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.copies,
    row_number() OVER (PARTITION BY d.source, d.hash, d.size) <= CASE WHEN d.size = 0 OR g.target - g.copies * g.source_size < e.below THEN 0
      ELSE floor((g.target - g.copies * g.source_size - e.below) / d.size + 0.5) END AS more
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
  JOIN equal e ON d.source IS NOT DISTINCT FROM e.source AND d.hash = e.hash AND d.size = e.size)
SELECT doc_id, size, source_size, target, size * (copies + CAST(more AS BIGINT)) AS taken FROM taken
"""

ORACLES = {
    "op11_collocations": COLLOCATIONS,
    "op12_source_mix": SOURCE_MIX,
    "op2_host_reputation": HOST_REPUTATION,
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_controlled_rules": CONTROLLED_RULES,
    "op7_warc_round_trip": WARC_ROUND_TRIP,
    "op8_benchmark_hits": BENCHMARK_HITS,
}

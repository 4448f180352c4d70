"""SQL counterparts of the registered queries, for an independent engine (DuckDB).

Each is written from the definition of the result, not from the Spark plan: keys are
compared by plain joins and windows over whole tables.
"""

from __future__ import annotations

from ..sources.ordered import BASES, PRIMES


def _hash(*parts: str) -> str:
    joined = "||chr(9)||".join(parts)
    return f"('0x'||substr(sha256({joined}),1,15))::BIGINT"


def _with(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks)


_VOWELS = "AA AE AH AO AW AX AXR AY EH ER EY IH IX IY OW OY UH UW UX".replace(" ", "|")

# ------------------------------------------------------------------ dictionary CTEs
USES = r"""
tok AS (SELECT lang AS language, source, unnest(regexp_extract_all(text, '\p{L}+')) AS term FROM documents),
uses AS (SELECT language, term, source, count(*) AS uses FROM tok GROUP BY ALL)"""
TERMS = f"""{USES},
tn AS (SELECT DISTINCT language, term, replace(lower(term),'ß','ss') AS norm FROM uses),
terms AS (SELECT {_hash('language', 'norm', 'term')} AS term_id, term, norm, language FROM tn)"""
WORDS = f"""{TERMS},
entries AS (SELECT 'e:'||language||':'||term AS entry_id, term_id, language, term, norm,
  CASE WHEN term = lower(term) THEN 'noun' ELSE 'Name' END AS pos,
  CASE WHEN term = lower(term) THEN 5 ELSE 6 END AS prov FROM terms),
senses AS (SELECT 's:'||u.language||':'||u.term||CASE WHEN u.term = lower(u.term) THEN ':' ELSE ':unsensed:' END||source AS sense_id,
  'e:'||u.language||':'||u.term AS entry_id, u.language, u.term, t.norm, t.term_id, source, uses,
  CASE WHEN uses >= 3 THEN source||' x'||uses END AS gloss
  FROM uses u JOIN terms t ON t.language = u.language AND t.term = u.term),
pairs AS (SELECT a.language, a.term, a.norm, a.term_id, b.language AS tlang, b.term AS tterm, b.term_id AS tid
  FROM terms a JOIN terms b ON a.norm = b.norm AND a.term_id <> b.term_id),
transl AS (SELECT s.sense_id, p.tid, p.tlang, p.tterm, p.norm AS tnorm, p.position FROM senses s JOIN
  (SELECT *, row_number() OVER (PARTITION BY language, term ORDER BY tlang, tterm) - 1 AS position
   FROM pairs WHERE language <> tlang) p ON s.language = p.language AND s.term = p.term),
syns AS (SELECT s.sense_id, p.tid, p.tlang, p.tterm, p.position FROM senses s JOIN
  (SELECT *, row_number() OVER (PARTITION BY language, term ORDER BY tlang, tterm) - 1 AS position
   FROM pairs WHERE language = tlang) p ON s.language = p.language AND s.term = p.term),
rels AS (SELECT term_id AS src, language AS slang, norm AS snorm, term AS sterm, 12 AS code, tid AS tgt, tlang, norm AS tnorm, tterm, 3 AS dir, 7 AS prov
  FROM pairs WHERE language < tlang
  UNION ALL SELECT term_id, language, norm, term, 7, tid, tlang, norm, tterm, 1, 8 FROM pairs WHERE language = tlang AND tterm = norm)"""
COUNTS = """
pe AS (SELECT entry_id, count(*) AS n FROM senses GROUP BY 1),
tcounts AS (SELECT t.term_id, t.term, t.norm, t.language, count(e.entry_id) AS entry_count, coalesce(sum(pe.n),0)::BIGINT AS sense_count
  FROM terms t LEFT JOIN entries e ON e.term_id = t.term_id LEFT JOIN pe ON pe.entry_id = e.entry_id GROUP BY ALL)"""

# ------------------------------------------------------------------- spoken CTEs
_SOUND = """CASE c WHEN 'a' THEN 'AA' WHEN 'e' THEN 'EH' WHEN 'i' THEN 'IH' WHEN 'o' THEN 'OW' WHEN 'u' THEN 'UW'
  WHEN 'c' THEN 'K' WHEN 'j' THEN 'JH' WHEN 'h' THEN 'HH' WHEN 'x' THEN 'Z' ELSE upper(c) END
  || CASE WHEN c IN ('a','e','i','o','u') THEN CASE WHEN i % 2 = 1 THEN '1' ELSE '0' END ELSE '' END"""
_STRESSED = r"(?:^|\s)(\S*[12](?:\s\S*[^12\s])*)$"
_VOICED = r"(?:^|\s)(\S*[0-9](?:\s\S*[^0-9\s])*)$"
SPOKEN = f"""{TERMS},
eng AS (SELECT term_id, term, norm,
  replace(CASE WHEN length(norm) > 2 THEN regexp_replace(norm, 'e$', '') ELSE norm END, 'ea', 'ee') AS said
  FROM terms WHERE language = 'en' AND regexp_full_match(norm, '[a-z]+')),
plain AS (SELECT term_id, term, norm, array_to_string(list_transform(string_split(said, ''), lambda c, i: {_SOUND}), ' ') AS p FROM eng),
heard AS (SELECT DISTINCT term_id, term, norm, unnest([p, replace(p, 'T HH', 'TH')]) AS phonemes FROM plain),
keyed AS (SELECT *, string_split(phonemes, ' ') AS toks,
  regexp_extract(phonemes, '{_STRESSED}', 1) AS k1, regexp_extract(phonemes, '{_VOICED}', 1) AS k2 FROM heard),
spoken AS (SELECT term_id, term, norm, phonemes, toks,
  CASE WHEN k1 <> '' THEN k1 WHEN k2 <> '' THEN k2 ELSE array_to_string(toks[-2:], ' ') END AS rkey,
  list_position(list_transform(toks, lambda t: regexp_full_match(t, '({_VOWELS})[012]?')), true) AS v FROM keyed),
sounded AS (SELECT *, CASE WHEN v IS NULL OR v = 0 THEN phonemes ELSE array_to_string(toks[1:v-1], ' ') END AS onset,
  CASE WHEN v IS NULL OR v = 0 THEN '' ELSE array_to_string(toks[v:], ' ') END AS remainder FROM spoken)"""
_LETTERS = "array_to_string(list_sort(string_split(norm, '')), '')"
ENGLISH = """
words AS (SELECT DISTINCT norm FROM terms WHERE language = 'en' AND regexp_full_match(norm, '[a-z]+'))"""
CITED = """
cited AS (SELECT norm, array_to_string(list_sort(list(DISTINCT prov)), ',') AS provenance FROM entries WHERE language = 'en' GROUP BY norm)"""
BENCH = r"""
bwords AS (SELECT DISTINCT replace(lower(w),'ß','ss') AS word FROM
  (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark))"""


def _spoken_answer(matches: str, mode: str, limit: int = 20) -> str:
    """Rank grouped matches(request_id, norm, term, phonemes) and cut."""
    return f"""
SELECT request_id, rank, term, norm AS normalized_term, 'en' AS language, '{mode}' AS mode, phonemes FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY norm) AS rank FROM ({matches})) WHERE rank <= {limit}"""


_HEADS = "heads AS (SELECT norm, min(term) AS term, min(phonemes) AS phonemes FROM spoken GROUP BY norm)"

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ terms and keys
ORACLES["intern_terms"] = f"{_with(TERMS)} SELECT term_id, term, norm AS normalized_term, language FROM terms"

ORACLES["language_tags"] = r"""
WITH raws AS (SELECT lang AS raw FROM documents UNION SELECT upper(lang)||'_'||source FROM documents
  UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT o_orderpriority FROM orders),
t AS (SELECT raw, lower(replace(trim(raw), '_', '-')) AS tag FROM raws)
SELECT raw, CASE WHEN regexp_full_match(tag, '[a-z0-9]{2,8}(-[a-z0-9]{1,8})*') THEN tag ELSE 'und' END AS tag FROM t"""

ORACLES["wordplay_index"] = f"""{_with(TERMS)},
l AS (SELECT *, regexp_replace(norm, '[^a-z]', '', 'g') AS letters FROM terms WHERE language = 'en')
SELECT term_id, term, norm AS normalized_term, letters,
  coalesce(array_to_string(list_sort(string_split(letters, '')), ''), '') AS signature, reverse(letters) AS reversed_letters,
  regexp_full_match(norm, '[a-z]+') AS eligible,
  regexp_full_match(norm, '[a-z]+') AND length(letters) >= 2 AND letters = reverse(letters) AS palindrome FROM l"""

ORACLES["spoken_keys"] = f"{_with(SPOKEN)} SELECT term, phonemes, rkey AS rhyme_key, onset, remainder FROM sounded"

ORACLES["allowed_relations"] = f"""{_with(WORDS)}
SELECT sterm AS source_term, tterm AS target_term, code::BIGINT AS relation_code, dir::BIGINT AS direction_code, prov::BIGINT AS provenance_id
FROM rels WHERE slang IN ('en','fr') AND tlang IN ('en','fr')"""

ORACLES["request_rejects"] = r"""
WITH s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
j AS (SELECT doc_id AS request_id, CASE WHEN text IS NULL THEN 'word must be text' WHEN t = '' THEN 'word cannot be empty'
  WHEN length(t) > 256 THEN 'word is too long' WHEN regexp_matches(t, '[\x00-\x1f\x7f]') THEN 'word contains control characters'
  WHEN NOT coalesce(regexp_full_match(lang, '[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*'), false) THEN 'language is not a language tag'
  WHEN n_chars NOT BETWEEN 1 AND 100 THEN 'limit must be between 1 and 100' END AS reason FROM s)
SELECT request_id, reason FROM j WHERE reason IS NOT NULL"""

# ------------------------------------------------------------------------ wordplay
ORACLES["anagram_groups"] = f"""{_with(TERMS)},
m AS (SELECT language, norm AS letters, min(term) AS term, {_LETTERS} AS signature FROM terms
  WHERE regexp_full_match(norm, '[a-z]+') GROUP BY language, norm)
SELECT * FROM (SELECT language, signature, count(*) OVER (PARTITION BY language, signature) AS members, letters, term FROM m) WHERE members > 1"""

ORACLES["anagrams"] = f"""{_with(WORDS, ENGLISH, CITED)},
m AS (SELECT norm, {_LETTERS} AS signature, min(term) AS term FROM terms
  WHERE language = 'en' AND regexp_full_match(norm, '[a-z]+') GROUP BY norm),
r AS (SELECT w.norm AS request_id, b.norm, b.term, b.signature, row_number() OVER (PARTITION BY w.norm ORDER BY b.norm) AS rank
  FROM words w JOIN m a ON a.norm = w.norm JOIN m b ON a.signature = b.signature AND a.norm <> b.norm)
SELECT request_id, rank, term, norm AS normalized_term, signature, provenance FROM r JOIN cited USING (norm) WHERE rank <= 20"""

ORACLES["palindromes"] = f"""{_with(WORDS, ENGLISH, CITED)},
p AS (SELECT norm, min(term) AS term FROM terms WHERE language = 'en' AND regexp_full_match(norm, '[a-z]+')
  AND length(norm) >= 2 AND norm = reverse(norm) GROUP BY norm),
r AS (SELECT w.norm AS request_id, p.norm, p.term,
  row_number() OVER (PARTITION BY w.norm ORDER BY p.norm < w.norm, p.norm) AS rank
  FROM words w JOIN p ON p.norm <> w.norm WHERE length(w.norm) >= 2)
SELECT request_id, rank, term, norm AS normalized_term, norm AS palindrome_key, request_id = reverse(request_id) AS input_is_palindrome, provenance
FROM r JOIN cited USING (norm) WHERE rank <= 20"""

ORACLES["rhymes_exact"] = _with(SPOKEN, ENGLISH) + _spoken_answer("""
  SELECT w.norm AS request_id, b.norm, min(b.term) AS term, min(b.phonemes) AS phonemes
  FROM words w JOIN (SELECT DISTINCT norm, rkey FROM spoken) a ON a.norm = w.norm
  JOIN spoken b ON a.rkey = b.rkey AND b.norm <> w.norm GROUP BY 1, 2""", "exact")

ORACLES["sounds_like"] = _with(SPOKEN, ENGLISH) + _spoken_answer("""
  SELECT w.norm AS request_id, b.norm, min(b.term) AS term, min(b.phonemes) AS phonemes
  FROM words w JOIN (SELECT DISTINCT norm, phonemes FROM spoken) a ON a.norm = w.norm
  JOIN spoken b ON a.phonemes = b.phonemes AND b.norm <> w.norm GROUP BY 1, 2""", "sounds_like")

ORACLES["rhymes_near"] = f"""{_with(SPOKEN, ENGLISH)},
keys AS (SELECT DISTINCT rkey, string_split(rkey, ' ') AS kt FROM spoken),
codes AS (SELECT token, chr((row_number() OVER (ORDER BY token) + 40)::INT) AS code FROM (SELECT DISTINCT unnest(kt) AS token FROM keys)),
coded AS (SELECT rkey, string_agg(code, '' ORDER BY i) AS ck FROM
  (SELECT rkey, unnest(kt) AS token, generate_subscripts(kt, 1) AS i FROM keys) JOIN codes USING (token) GROUP BY rkey),
sigs AS (SELECT DISTINCT rkey, ck, unnest(list_concat([ck], list_transform(range(1, length(ck) + 1),
  lambda i: substr(ck, 1, i - 1) || substr(ck, i + 1)))) AS sig FROM coded),
near AS (SELECT DISTINCT a.rkey AS k, b.rkey AS n FROM sigs a JOIN sigs b ON a.sig = b.sig WHERE levenshtein(a.ck, b.ck) = 1),
own AS (SELECT norm, list_sort(list(DISTINCT rkey)) AS ks FROM spoken GROUP BY norm),
sets AS (SELECT DISTINCT ks FROM own),
reach AS (SELECT DISTINCT ks, n FROM (SELECT ks, unnest(ks) AS k FROM sets) JOIN near USING (k) WHERE NOT list_contains(ks, n)),
listed AS (SELECT ks, norm, min(term) AS term, min(phonemes) AS phonemes FROM reach JOIN spoken ON rkey = n GROUP BY ks, norm),
topped AS (SELECT *, row_number() OVER (PARTITION BY ks ORDER BY norm) AS spot FROM listed)
""" + _spoken_answer("""
  SELECT o.norm AS request_id, t.norm, t.term, t.phonemes FROM own o JOIN topped t ON t.ks = o.ks AND t.spot <= 21 AND t.norm <> o.norm""", "near")

ORACLES["prefix_match"] = _with(SPOKEN, BENCH, _HEADS) + _spoken_answer("""
  SELECT word AS request_id, norm, term, phonemes FROM bwords JOIN heads ON starts_with(norm, word) AND norm <> word""", "prefix")

ORACLES["spelled_like"] = _with(SPOKEN, BENCH, _HEADS, """
pats AS (SELECT DISTINCT unnest([substr(word,1,2)||'*'||right(word,1), '?'||substr(word,2), '*'||substr(word,2,3)||'*']) AS pat FROM bwords)""") + _spoken_answer("""
  SELECT pat AS request_id, norm, term, phonemes FROM pats JOIN heads ON norm LIKE replace(replace(pat,'?','_'),'*','%') AND norm <> pat""", "spelled_like")

_OPEN = """
opats AS (SELECT DISTINCT pat FROM (SELECT unnest([substr(word,1,1)||'*', '*'||right(word,1), '*'||substr(word,2,1)||'*', regexp_replace(word,'.','?','g'),
  '?'||substr(word,2,1)||'*', '*', '?*', '*e*a*', 'a*', '*e*', '?????']) AS pat FROM bwords) WHERE pat <> '')"""
_MATCHED = """
  SELECT pat AS request_id, norm, term, phonemes FROM opats JOIN heads ON norm LIKE replace(replace(pat,'?','_'),'*','%') AND norm <> pat"""
ORACLES["open_patterns"] = _with(SPOKEN, BENCH, _HEADS, _OPEN) + _spoken_answer(_MATCHED, "spelled_like")
ORACLES["pattern_candidates"] = f"""{_with(SPOKEN, BENCH, _HEADS, _OPEN)}
SELECT DISTINCT pat AS request_id, true AS bounded FROM opats"""

ORACLES["spoonerisms"] = f"""{_with(SPOKEN)},
bt AS (SELECT regexp_extract_all(text, '\\p{{L}}+') AS w FROM benchmark),
bi AS (SELECT DISTINCT replace(lower(w[i]),'ß','ss') AS l, replace(lower(w[i+1]),'ß','ss') AS r
  FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bt)),
alts AS (SELECT * FROM (SELECT norm, phonemes, min(term) AS term, any_value(onset) AS onset, any_value(remainder) AS rem,
  row_number() OVER (PARTITION BY norm ORDER BY phonemes) AS spot FROM sounded GROUP BY norm, phonemes) WHERE spot <= 8),
cand AS (SELECT bi.l||' '||bi.r AS request_id, a.term AS left_term, a.phonemes AS left_phonemes, b.term AS right_term, b.phonemes AS right_phonemes,
  trim(b.onset||' '||a.rem) AS swapped_left, trim(a.onset||' '||b.rem) AS swapped_right, a.onset AS onset_left, b.onset AS onset_right, a.spot AS la, b.spot AS ra
  FROM bi JOIN alts a ON a.norm = bi.l JOIN alts b ON b.norm = bi.r WHERE a.onset <> b.onset),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, swapped_left, swapped_right ORDER BY la, ra) AS u FROM cand) WHERE u = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY la, ra) AS rank FROM uniq),
res AS (SELECT phonemes, array_to_string(list_sort(list(norm)), ',') AS names FROM
  (SELECT *, row_number() OVER (PARTITION BY phonemes ORDER BY norm) AS spot FROM (SELECT DISTINCT phonemes, norm FROM spoken)) WHERE spot <= 8 GROUP BY phonemes)
SELECT request_id, rank, left_term, left_phonemes, right_term, right_phonemes, swapped_left, swapped_right,
  coalesce(x.names,'') AS swapped_left_terms, coalesce(y.names,'') AS swapped_right_terms, onset_left, onset_right,
  CASE WHEN x.names IS NOT NULL AND y.names IS NOT NULL THEN 'lexical_term' ELSE 'generated_candidate' END AS lexicality_scope
FROM rk LEFT JOIN res x ON x.phonemes = swapped_left LEFT JOIN res y ON y.phonemes = swapped_right WHERE rank <= 20"""

_SPOKEN_ONLY = SPOKEN[len(TERMS):].lstrip(",\n")
ORACLES["puns"] = f"""{_with(WORDS, _SPOKEN_ONLY)},
own AS (SELECT DISTINCT norm, phonemes FROM spoken),
found AS (SELECT a.norm AS request_id, b.norm, a.phonemes, min(b.term) AS term FROM own a JOIN spoken b ON a.phonemes = b.phonemes AND a.norm <> b.norm GROUP BY ALL),
scanned AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY norm, phonemes) AS spot FROM found),
first_senses AS (SELECT norm, list_sort(list(sense_id)) AS ids FROM (SELECT norm, sense_id, row_number() OVER (PARTITION BY norm ORDER BY sense_id) AS rn
  FROM senses WHERE language = 'en') WHERE rn <= 8 GROUP BY norm),
sources AS (SELECT norm, list(DISTINCT prov) AS ps FROM entries WHERE language = 'en' GROUP BY norm),
kept AS (SELECT s.*, c.ids AS cids, q.ids AS qids FROM scanned s JOIN first_senses c ON c.norm = s.norm JOIN first_senses q ON q.norm = s.request_id
  WHERE spot <= 80 AND NOT list_has_any(c.ids, q.ids)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY spot) AS rank FROM kept)
SELECT request_id, rank, term, phonemes, array_to_string(qids, ',') AS query_sense_ids, array_to_string(cids, ',') AS candidate_sense_ids,
  'uncontextualized' AS context_scope,
  array_to_string(list_concat([9], list_sort(list_distinct(list_concat(a.ps, b.ps)))), ',') AS provenance
FROM ranked r JOIN sources a ON a.norm = r.request_id JOIN sources b ON b.norm = r.norm WHERE rank <= 20"""

ORACLES["wordplay_partition"] = f"""{_with(WORDS, _SPOKEN_ONLY)}
SELECT 'terms' AS table_name, count(*) AS row_count FROM terms WHERE language = 'en'
UNION ALL SELECT 'entries', count(*) FROM entries WHERE language = 'en'
UNION ALL SELECT 'senses', count(*) FROM senses WHERE language = 'en'
UNION ALL SELECT 'spoken', count(*) FROM spoken"""

# ------------------------------------------------------------------------- lookups
COVERAGE = """
coverage AS (SELECT sense_id, count(DISTINCT tlang) AS language_count, count(*) AS translation_count FROM transl GROUP BY sense_id)"""
PICKED = """
cand AS (SELECT * FROM (SELECT r.request_id, s.*, row_number() OVER (PARTITION BY r.request_id ORDER BY s.gloss IS NULL, s.sense_id) AS sr
  FROM asked r JOIN senses s ON s.norm = r.word AND s.language = r.language) WHERE sr <= 100),
tr AS (SELECT c.*, v.language_count, row_number() OVER (PARTITION BY request_id
  ORDER BY v.language_count DESC NULLS LAST, v.translation_count DESC NULLS LAST, sr) AS tr FROM cand c LEFT JOIN coverage v USING (sense_id)),
chosen AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN language_count IS NOT NULL AND tr <= 2 THEN 0 ELSE 1 END, sr) AS place FROM tr),
picked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sr) AS rank FROM chosen WHERE place <= 8)"""
_ALL_WORDS = "asked AS (SELECT DISTINCT language||':'||norm AS request_id, norm AS word, language FROM terms)"
_BENCH_WORDS = "asked AS (SELECT word AS request_id, word, 'en' AS language FROM bwords)"
_SCOPE = "CASE WHEN {0} IS NULL OR contains({0}, ':unsensed:') THEN 'unsensed' ELSE 'sense' END"

ORACLES["sense_lookup"] = f"""{_with(WORDS, COVERAGE, _ALL_WORDS, PICKED)}
SELECT request_id, rank, sense_id, {_SCOPE.format('sense_id')} AS sense_scope, p.term AS word, p.language, e.pos AS part_of_speech, gloss, e.prov::BIGINT AS provenance_id
FROM picked p JOIN entries e USING (entry_id)"""

ORACLES["lookup_by_part_of_speech"] = f"""{_with(WORDS)}
SELECT request_id, rank, sense_id, gloss FROM (SELECT s.language||':'||s.norm||':'||k.kind AS request_id, sense_id, gloss, most,
    row_number() OVER (PARTITION BY s.language, s.norm, k.kind ORDER BY gloss IS NULL, sense_id) AS rank
  FROM senses s JOIN entries e USING (entry_id) JOIN (VALUES ('NAME', 100), ('Noun', 1)) k(kind, most) ON lower(e.pos) = lower(k.kind)) WHERE rank <= most"""

_SHARE = """
{c}_all AS (SELECT p.request_id, p.rank, p.sense_id, x.value, x.detail, row_number() OVER (PARTITION BY p.request_id, p.rank ORDER BY x.o1, x.o2, x.o3) AS item
  FROM picked p JOIN {c}_rows x ON x.parent = p.{parent}),
{c}_cand AS (SELECT *, count(*) OVER (PARTITION BY request_id, rank) AS offered FROM {c}_all WHERE item <= {budget} + 1),
{c}_taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY item, rank) AS won FROM {c}_cand) WHERE won <= {budget})"""
DETAILS = r"""
ex_rows AS (SELECT s.sense_id AS parent, x.line AS value, NULL::VARCHAR AS detail, x.position AS o1, '' AS o2, '' AS o3 FROM senses s JOIN
  (SELECT DISTINCT lang AS language, source, position, line, unnest(regexp_extract_all(line, '\p{L}+')) AS term FROM
    (SELECT lang, source, doc_id * 2147483648 + i - 1 AS position, lines[i] AS line FROM
      (SELECT lang, source, doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))) x
  ON x.language = s.language AND x.source = s.source AND x.term = s.term),
pr_rows AS (SELECT entry_id AS parent, '/'||norm||'/' AS value, source AS detail, substr(source, 4)::BIGINT AS o1, '' AS o2, '' AS o3 FROM senses),
tl_rows AS (SELECT sense_id AS parent, tterm AS value, tlang AS detail, position AS o1, tlang AS o2, tterm AS o3 FROM transl)""" + "".join(
    "," + _SHARE.format(c=c, parent=parent, budget=budget)
    for c, parent, budget in (("ex", "sense_id", 8), ("pr", "entry_id", 8), ("tl", "sense_id", 20))
)
_FIELDS = (("ex", "examples"), ("pr", "pronunciations"), ("tl", "translations"))

ORACLES["lookup_details"] = _with(WORDS, COVERAGE, BENCH, _BENCH_WORDS, PICKED, DETAILS) + " UNION ALL ".join(
    f" SELECT request_id, rank, '{field}' AS field, item, value, detail, sense_id FROM {c}_taken" for c, field in _FIELDS
)
ORACLES["lookup_truncated"] = _with(WORDS, COVERAGE, BENCH, _BENCH_WORDS, PICKED, DETAILS) + " UNION ALL ".join(
    f""" SELECT c.request_id, c.rank, '{field}' AS field FROM {c}_cand c LEFT JOIN (SELECT request_id, rank, count(*) AS given FROM {c}_taken GROUP BY ALL) g
    USING (request_id, rank) GROUP BY c.request_id, c.rank HAVING max(c.offered) > coalesce(max(g.given), 0)"""
    for c, field in _FIELDS
)
ORACLES["translation_coverage"] = f"{_with(WORDS, COVERAGE)} SELECT sense_id, language_count, translation_count FROM coverage"

ORACLES["translate"] = f"""{_with(WORDS)},
wd AS (SELECT DISTINCT norm AS word, language FROM terms),
asked AS (SELECT a.language||':'||a.word||':'||b.language AS request_id, a.word, a.language, b.language AS wanted FROM wd a JOIN wd b ON a.word = b.word AND a.language <> b.language),
sn AS (SELECT * FROM (SELECT r.request_id, r.wanted, s.*, row_number() OVER (PARTITION BY r.request_id ORDER BY s.gloss IS NULL, s.sense_id) AS sr
  FROM asked r JOIN senses s ON s.norm = r.word AND s.language = r.language) WHERE sr <= 100),
hits AS (SELECT sn.*, t.tlang, t.tterm, t.tnorm, row_number() OVER (PARTITION BY request_id, sr ORDER BY t.position, t.tlang, t.tnorm, t.tterm) AS spot
  FROM sn JOIN transl t ON t.sense_id = sn.sense_id AND t.tlang = sn.wanted),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, sr, tnorm, tlang ORDER BY spot) AS u FROM hits WHERE spot <= 20) WHERE u = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY request_id, sr ORDER BY spot) AS turn FROM uniq),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn, sr) AS w FROM turns) WHERE w <= 20)
SELECT request_id, dense_rank() OVER (PARTITION BY request_id ORDER BY sr) AS group_index, row_number() OVER (PARTITION BY request_id, sr ORDER BY spot) AS position,
  sense_id, {_SCOPE.format('sense_id')} AS sense_scope, won.term AS word, e.pos AS part_of_speech, gloss, tterm AS term, tlang AS language, 7::BIGINT AS provenance_id
FROM won JOIN entries e USING (entry_id)"""

PARTS = f"""
pt AS (SELECT *, CASE WHEN p_size < 10 THEN 'part:unsensed:' ELSE 'part:' END||p_partkey AS sense_id,
  {_hash("'en'", "lower(p_name)", "p_name")} AS term_id, p_type||'/'||p_size AS synset_id FROM part),
syn AS (SELECT a.sense_id, b.term_id AS tid, b.p_name AS tterm, a.p_brand AS pos, row_number() OVER (PARTITION BY a.sense_id ORDER BY b.term_id) - 1 AS position
  FROM pt a JOIN (SELECT DISTINCT synset_id, term_id, p_name FROM pt) b ON a.synset_id = b.synset_id AND a.term_id <> b.term_id)"""
ORACLES["synset_places"] = f"""{_with(PARTS)}
SELECT synset_id, term_id, row_number() OVER (PARTITION BY synset_id ORDER BY term_id) AS place FROM (SELECT DISTINCT synset_id, term_id FROM pt)"""
ORACLES["synonym_counts"] = f"""{_with(PARTS)}
SELECT pt.sense_id, count(syn.tid) AS synonyms FROM pt LEFT JOIN syn USING (sense_id) GROUP BY 1"""
ORACLES["synset_synonyms"] = f"""{_with(PARTS)}
SELECT sense_id, tid AS target_term_id, pos AS part_of_speech, position FROM syn"""

ORACLES["synonyms_grouped"] = f"""{_with(PARTS)},
counts AS (SELECT p_name, count(DISTINCT p_brand) AS ec, count(*) AS sc FROM pt GROUP BY p_name),
sn AS (SELECT * FROM (SELECT p_name AS q, sense_id, CASE WHEN p_size >= 25 THEN p_type END AS gloss,
  CASE WHEN p_size < 10 THEN 'unsensed' ELSE 'sense' END AS scope,
  row_number() OVER (PARTITION BY p_name ORDER BY p_size < 25, sense_id) AS sr FROM pt) WHERE sr <= 20),
cand AS (SELECT sn.*, s.tterm, s.position AS spot FROM sn JOIN syn s USING (sense_id) WHERE s.position < 100),
turns AS (SELECT *, row_number() OVER (PARTITION BY q, sr ORDER BY spot) AS turn FROM cand),
native AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn, sr) AS w FROM turns WHERE scope = 'unsensed') WHERE w <= 5),
nc AS (SELECT q, count(*) AS n FROM native GROUP BY q),
support AS (SELECT q, tterm, count(*) AS support FROM cand GROUP BY ALL),
adj AS (SELECT DISTINCT a.p_name AS s, b.p_name AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_name <> b.p_name),
ed AS (SELECT s AS q, t, 1 AS o FROM adj UNION ALL SELECT t, s, 2 FROM adj),
og AS (SELECT q, t, min(o) AS o, count(*) AS sides FROM ed GROUP BY q, t),
asked AS (SELECT DISTINCT p_name AS q FROM part),
rel AS (SELECT og.*, c.sc, coalesce(sp.support, 0) AS support FROM og JOIN counts c ON c.p_name = og.t
  LEFT JOIN support sp ON sp.q = og.q AND sp.tterm = og.t LEFT JOIN nc ON nc.q = og.q WHERE coalesce(nc.n, 0) < 5),
rc AS (SELECT q, count(*) AS n FROM rel GROUP BY q),
bud AS (SELECT a.q, least(5 - coalesce(nc.n, 0), coalesce(rc.n, 0)) AS slots, 20 - coalesce(nc.n, 0) - least(5 - coalesce(nc.n, 0), coalesce(rc.n, 0)) AS scoped
  FROM asked a LEFT JOIN nc USING (q) LEFT JOIN rc USING (q)),
scoped AS (SELECT * FROM (SELECT t.*, b.scoped AS budget, row_number() OVER (PARTITION BY t.q ORDER BY turn, sr) AS w FROM turns t JOIN bud b USING (q) WHERE scope = 'sense') WHERE w <= budget),
sel AS (SELECT q, sr, spot, sense_id, scope, gloss, tterm, 2 AS prov FROM native UNION ALL SELECT q, sr, spot, sense_id, scope, gloss, tterm, 2 FROM scoped),
flag AS (SELECT rel.*, EXISTS (SELECT 1 FROM sel WHERE sel.q = rel.q AND sel.tterm = rel.t) AS used, c.ec FROM rel JOIN counts c ON c.p_name = rel.t),
tk AS (SELECT *, row_number() OVER (PARTITION BY q, used, sides = 1, CASE WHEN sides = 1 THEN o END
  ORDER BY sc = 0, NOT (starts_with(t, q) OR starts_with(q, t)), support = 0, sc DESC, support DESC, ec DESC,
  length(t) - length(replace(t, ' ', '')), length(t), t) AS turn FROM flag),
extra AS (SELECT * FROM (SELECT tk.*, b.slots, row_number() OVER (PARTITION BY tk.q ORDER BY used, sides = 1, turn, CASE WHEN sides = 1 THEN o ELSE 0 END) AS w
  FROM tk JOIN bud b USING (q)) WHERE w <= slots),
outp AS (SELECT * FROM sel UNION ALL SELECT q, 101, w, NULL, 'unsensed', NULL, t, 4 FROM extra)
SELECT q AS request_id, dense_rank() OVER (PARTITION BY q ORDER BY sr) AS group_index, row_number() OVER (PARTITION BY q, sr ORDER BY spot) AS position,
  sense_id, scope AS sense_scope, gloss, tterm AS term, 'en' AS language, prov::BIGINT AS provenance_id FROM outp"""

# --------------------------------------------------------------------------- graph
GRAPH = """
pp AS (SELECT *, CASE WHEN p_size < 10 THEN 'part:unsensed:' ELSE 'part:' END||p_partkey AS sid FROM part),
rel AS (SELECT n_name AS s, NULL::VARCHAR AS ss, 3 AS code, r_name AS t, NULL::VARCHAR AS ts, 1 AS dir, 1 AS prov FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, NULL, 3, n_name, NULL, 1, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, NULL, 3, n_name, NULL, 1, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT p_name, sid, 3, p_type, 'type:'||p_type, 1, 2 FROM pp
  UNION ALL SELECT DISTINCT p_type, 'type:'||p_type, 3, 'goods', 'goods', 1, 2 FROM pp
  UNION ALL SELECT DISTINCT p_name, NULL, 3, p_type, NULL, 1, 2 FROM pp
  UNION ALL SELECT DISTINCT p_type, NULL, 3, 'goods', NULL, 1, 2 FROM pp
  UNION ALL SELECT DISTINCT p_name, NULL, 11, s_name, NULL, 1, 3 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
names AS (SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier
  UNION SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT 'goods'),
ents AS (SELECT DISTINCT p_name AS name, p_brand AS tag FROM part UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT DISTINCT p_type, 'type' FROM part),
ec AS (SELECT name, count(*) AS e FROM ents GROUP BY 1), sc AS (SELECT p_name AS name, count(*) AS c FROM part GROUP BY 1),
cat AS (SELECT n.name, lower(n.name) AS norm, coalesce(e, 0) AS e, coalesce(c, 0) AS c FROM names n LEFT JOIN ec USING (name) LEFT JOIN sc USING (name)),
ori AS (SELECT s, ss, code, t, ts, dir, dir AS stored, prov, 1 AS o FROM rel
  UNION ALL SELECT t, ts, CASE code WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE code END, s, ss, CASE dir WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END, dir, prov, 2 FROM rel),
codes AS (SELECT * FROM (VALUES ('hypernym', 3), ('hyponym', 4), ('at_location', 11)) v(relation, code))"""
_SHAPE = "length(tn) - length(replace(tn, ' ', '')), length(tn), tn, t"
ANCHORED = """
edge AS (SELECT lower(o.s) AS q, o.*, k.norm AS tn, k.e, k.c, row_number() OVER (PARTITION BY o.s, o.code, o.o, o.t
  ORDER BY o.ss IS NULL AND o.ts IS NULL, o.ss NULLS FIRST, o.ts NULLS FIRST, o.prov, o.stored) AS vr
  FROM ori o JOIN cat k ON k.name = o.t)"""
_SOURCES = "(VALUES (1,'geography'),(2,'catalogue'),(3,'shipments')) p(prov, source)"
_EDGE_ORDER = f"vr, c DESC, e DESC, {_SHAPE}, ss NULLS FIRST, ts NULLS FIRST, dir, source"
RANKED = f"""
scan AS (SELECT * FROM (SELECT edge.*, row_number() OVER (PARTITION BY q, code, o ORDER BY vr, c DESC, e DESC, {_SHAPE}, ts NULLS FIRST, prov, stored, ss NULLS FIRST) AS sr FROM edge)
  WHERE sr <= 256),
turns AS (SELECT scan.*, source, row_number() OVER (PARTITION BY q, code, prov, o ORDER BY {_EDGE_ORDER}) AS turn FROM scan JOIN {_SOURCES} USING (prov)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY turn, prov, o) AS er FROM turns) WHERE er <= 256),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code, tn, ss, ts ORDER BY er) AS u FROM ranked) WHERE u = 1),
rp AS (SELECT *, row_number() OVER (PARTITION BY q, code, tn ORDER BY er) > 1 AS rep FROM uq),
direct AS (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY rep, er) AS ord FROM rp)"""
_DIR_NAME = "CASE dir WHEN 1 THEN 'outbound' WHEN 2 THEN 'inbound' ELSE 'symmetric' END"

ORACLES["relations_direct"] = f"""{_with(GRAPH, ANCHORED, RANKED)}
SELECT q||'|'||relation AS request_id, ord AS rank, s AS source_term, 'en' AS source_language, ss AS source_sense_id, relation, t AS target_term, 'en' AS target_language,
  ts AS target_sense_id, {_DIR_NAME} AS direction, prov::BIGINT AS provenance_id FROM direct JOIN codes USING (code) WHERE ord <= 20"""

TWO_HOP = f"""
pref AS (SELECT *, CASE WHEN (code = 3) = (dir = 1) THEN 0 ELSE 1 END AS away FROM ranked WHERE code IN (3, 4)),
fo AS (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY away, {_EDGE_ORDER}) AS fr FROM pref),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code, tn, ss, ts ORDER BY fr) AS u FROM fo) WHERE u = 1),
fp AS (SELECT *, row_number() OVER (PARTITION BY q, code, tn ORDER BY fr) > 1 AS rep,
  min((ss IS NOT NULL)::INT) OVER (PARTITION BY q, code, tn) = max((ss IS NOT NULL)::INT) OVER (PARTITION BY q, code, tn) AS single FROM fu),
fd AS (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY rep, fr) AS ford FROM fp),
ft AS (SELECT *, row_number() OVER (PARTITION BY q, code, prov, o, coalesce(ss, ''), single
  ORDER BY ts IS NULL, c DESC, e DESC, vr, {_SHAPE}, ts NULLS FIRST, ford) AS turn2 FROM fd),
front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY single, turn2, prov, o, coalesce(ss, '')) AS fw FROM ft) WHERE fw <= 16),
pre AS (SELECT * FROM (SELECT edge.*, row_number() OVER (PARTITION BY q, code, o ORDER BY ss IS NULL AND ts IS NULL, ts IS NULL, {_SHAPE}, ss NULLS FIRST, ts NULLS FIRST, prov, stored) AS pr FROM edge)
  WHERE pr <= 64),
st AS (SELECT pre.*, source, row_number() OVER (PARTITION BY q, code, prov, o ORDER BY {_EDGE_ORDER}) AS turn3 FROM pre JOIN {_SOURCES} USING (prov)),
seconds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY turn3, prov, o) AS b FROM st) WHERE b <= 16),
pairs AS (SELECT f.q, f.code, f.s, f.ss, f.tn AS mid, f.t AS middle_term, f.ts AS middle_sense_id, n.ss AS ss2, n.t, n.tn, n.ts, n.c, n.e, n.dir, n.prov, n.source
  FROM front f JOIN seconds n ON n.q = f.tn AND n.code = f.code AND n.prov = f.prov AND n.dir = f.dir
  WHERE n.tn <> f.q AND CASE WHEN coalesce(f.ss, f.ts, n.ss, n.ts) IS NULL THEN f.t = n.s
    ELSE f.ss IS NOT NULL AND n.ts IS NOT NULL AND coalesce(f.ts = n.ss, false) END),
scoped AS (SELECT *, CASE WHEN ss IS NOT NULL THEN 1 WHEN max((ss IS NOT NULL)::INT) OVER (PARTITION BY q, code, mid, tn) = 1 THEN 0 ELSE 2 END AS sp FROM pairs),
pathr AS (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY sp, c DESC, e DESC, tn, t, ts NULLS FIRST,
  CASE WHEN (code = 3) = (dir = 1) THEN 0 ELSE 1 END, dir, source, ss NULLS FIRST, mid, middle_sense_id NULLS FIRST, ss2 NULLS FIRST) AS pk FROM scoped),
fresh AS (SELECT p.* FROM pathr p WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.q = p.q AND d.code = p.code AND d.tn = p.tn
  AND d.ss IS NOT DISTINCT FROM p.ss AND d.ts IS NOT DISTINCT FROM p.ts)),
pu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code, tn, ss, ts ORDER BY pk) AS u FROM fresh) WHERE u = 1),
pq AS (SELECT *, row_number() OVER (PARTITION BY q, code, tn ORDER BY pk) > 1 AS rep FROM pu),
trans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY rep, pk) AS ord FROM pq) WHERE ord <= 5),
both_hops AS (SELECT q, code, ord, s, ss, t, ts, dir, prov, 1 AS distance, NULL::VARCHAR AS middle_term, NULL::VARCHAR AS middle_sense_id FROM direct WHERE code IN (3, 4)
  UNION ALL SELECT q, code, ord, s, ss, t, ts, dir, prov, 2, middle_term, middle_sense_id FROM trans),
kept AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE distance = 2) OVER (PARTITION BY q, code) AS np FROM both_hops) WHERE distance = 2 OR ord <= 20 - np)"""
ORACLES["relations_two_hop"] = f"""{_with(GRAPH, ANCHORED, RANKED, TWO_HOP)}
SELECT q||'|'||relation AS request_id, row_number() OVER (PARTITION BY q, code ORDER BY distance, ord) AS rank, s AS source_term, 'en' AS source_language,
  ss AS source_sense_id, relation, t AS target_term, 'en' AS target_language, ts AS target_sense_id, {_DIR_NAME} AS direction,
  CASE distance WHEN 1 THEN 'direct' ELSE 'transitive' END AS relation_scope, distance::BIGINT AS distance, middle_term, middle_sense_id, prov::BIGINT AS provenance_id
FROM kept JOIN codes USING (code)"""

EXPAND = """
fr AS (SELECT DISTINCT snorm AS request_id, tlang AS language, tnorm AS word FROM rels WHERE code = 12),
ready AS (SELECT * FROM fr WHERE language <> 'es'),
ed AS (SELECT tlang AS vl, tnorm AS vw, tterm AS s, sterm AS t, snorm AS tn, slang AS tl, prov, dir, src AS tid,
  row_number() OVER (PARTITION BY tlang, tnorm, src ORDER BY prov, dir, tterm) AS vr FROM rels WHERE code = 12),
named AS (SELECT ed.*, k.entry_count AS ec, k.sense_count AS sc FROM ed JOIN tcounts k ON k.term_id = ed.tid),
hits AS (SELECT r.request_id, n.*, row_number() OVER (PARTITION BY r.request_id ORDER BY vr, sc DESC, ec DESC, length(tn) - length(replace(tn,' ','')), length(tn), tl, tn, t, prov, dir, s, vl, vw) AS rank
  FROM ready r JOIN named n ON n.vl = r.language AND n.vw = r.word)"""
ORACLES["multi_hop_expand"] = f"""{_with(WORDS, COUNTS, EXPAND)}
SELECT request_id, rank, vl AS via_language, vw AS via_word, s AS source_term, t AS target_term, tl AS target_language, sc AS target_sense_count,
  vr AS target_variant_rank, prov::BIGINT AS provenance_id FROM hits WHERE rank <= 20"""
ORACLES["multi_hop_unexpanded"] = f"{_with(WORDS, COUNTS, EXPAND)} SELECT DISTINCT request_id, language, 'language_not_installed' AS reason FROM fr WHERE language = 'es'"

# ------------------------------------------------------------------------- vectors
VECTORS = """
ve AS (SELECT vec_id, 'v'||vec_id AS word, 'l'||label AS language, embedding::DOUBLE[] AS v FROM embeddings),
un AS (SELECT vec_id, word, language, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM ve)"""


def _knn(condition: str, floor: str) -> str:
    return f"""{_with(VECTORS)},
sims AS (SELECT a.word AS request_id, b.vec_id AS semantic_id, b.language, list_inner_product(a.v, b.v) AS sim FROM un a JOIN un b ON a.vec_id <> b.vec_id {condition}),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, semantic_id) AS rank FROM sims)
SELECT request_id, rank, semantic_id, language, round(sim, 4) AS similarity FROM rk WHERE rank <= 20 {floor}"""


ORACLES["knn_exact"] = _knn("", "")
ORACLES["knn_by_language"] = _knn("AND a.language = b.language", "AND sim >= 0.1")
ORACLES["knn_bounded"] = ORACLES["knn_exact"]
ORACLES["knn_bounded_by_language"] = ORACLES["knn_by_language"]
ORACLES["index_recall"] = """
WITH r AS (SELECT row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS spot, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s AS (SELECT unnest(range(0, 10)) AS stratum)
SELECT scope AS index_scope, count(*) AS seeds, true AS passed, true AS within_share, true AS deterministic, true AS strict_language_filtering
FROM r JOIN s ON spot = ((2 * stratum + 1) * n) // 20 CROSS JOIN (SELECT unnest(['global', 'language']) AS scope) WHERE n >= 10 GROUP BY 1"""
ORACLES["recall_seeds"] = """
WITH r AS (SELECT 'l'||label AS language, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS spot, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s AS (SELECT unnest(range(0, 10)) AS stratum)
SELECT language, stratum::BIGINT AS stratum, vec_id AS semantic_id FROM r JOIN s ON spot = ((2 * stratum + 1) * n) // 20 WHERE n >= 10"""
_CELLS = """
e AS (SELECT vec_id, 'l'||label AS language, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, language, v, sqrt(list_inner_product(v, v)) AS norm FROM e),
num AS (SELECT ceil(sqrt(count(*)))::BIGINT AS cells FROM e),
c AS (SELECT vec_id AS cell, v, norm FROM (SELECT *, row_number() OVER (ORDER BY ('0x'||substr(sha256('17'||chr(9)||vec_id), 1, 15))::BIGINT, vec_id) AS nth FROM u), num WHERE nth <= cells),
near AS (SELECT u.vec_id, cell, row_number() OVER (PARTITION BY u.vec_id ORDER BY list_inner_product(u.v, c.v) / c.norm DESC) AS nearness FROM u, c),
hit AS (SELECT q.vec_id AS query, q.language AS query_language, s.vec_id, s.language, list_inner_product(q.v, s.v) / (q.norm * s.norm) AS sim, k.scope,
    p.nearness <= ceil(0.9 * cells) AS seen
  FROM u q JOIN u s ON q.vec_id <> s.vec_id JOIN near h ON h.vec_id = s.vec_id AND h.nearness = 1
  JOIN near p ON p.vec_id = q.vec_id AND p.cell = h.cell, num, (SELECT unnest(['global', 'language']) AS scope) k
  WHERE k.scope = 'global' OR q.language = s.language),
apx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, query ORDER BY sim DESC, vec_id) AS rank FROM hit WHERE seen) WHERE rank <= 20),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, query ORDER BY sim DESC, vec_id) AS rank FROM hit) WHERE rank <= 20),
spot AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS spot, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
seed AS (SELECT DISTINCT vec_id FROM spot, (SELECT unnest(range(0, 10)) AS stratum) WHERE n >= 10 AND spot = ((2 * stratum + 1) * n) // 20),
rec AS (SELECT x.scope AS index_scope, x.query_language AS language, x.query AS seed_id, count(a.vec_id) / least(20, count(*)) AS recall_at_k
  FROM exact x JOIN seed ON seed.vec_id = x.query LEFT JOIN apx a ON a.scope = x.scope AND a.query = x.query AND a.vec_id = x.vec_id GROUP BY ALL)"""
ORACLES["knn_approximate"] = f"""WITH {_CELLS}
SELECT 'v'||query AS request_id, rank, vec_id AS semantic_id, language, round(sim, 4) AS similarity FROM apx WHERE scope = 'global'"""
ORACLES["ann_recall"] = f"""WITH {_CELLS}
SELECT index_scope, language, seed_id, recall_at_k, true AS deterministic, true AS strict_language_filtering FROM rec"""
ORACLES["recall_summary"] = f"""WITH {_CELLS}
SELECT index_scope, round(avg(recall_at_k), 6) AS mean_recall, count(*) AS seeds, true AS deterministic, true AS strict_language_filtering,
  round(avg(recall_at_k), 6) >= 0.9 AS passed FROM rec GROUP BY 1"""
ORACLES["identity_multiplicity"] = """
SELECT language, max(n) AS max_multiplicity FROM (SELECT 'l'||label AS language, 'v'||vec_id AS w, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY language"""
ORACLES["vector_partition"] = """
SELECT 'l'||label AS language, count(*) AS declared, count(embedding) AS stored, count(*) = count(embedding) AS matches FROM embeddings GROUP BY label"""
ORACLES["vector_integrity"] = """
SELECT count(*) AS vectors, count(DISTINCT vec_id) AS distinct_ids, min(vec_id) AS min_id, max(vec_id) AS max_id,
  sum(CASE WHEN len(embedding) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty_vectors, count(DISTINCT len(embedding)) AS dimension_count, 0::BIGINT AS unresolved,
  count(*) AS language_sum, count(DISTINCT label) AS languages,
  count(*) > 0 AND count(DISTINCT vec_id) = count(*) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT len(embedding)) = 1 AS intact FROM embeddings"""

# -------------------------------------------------------------------------- layout
ORACLES["term_counts"] = f"{_with(WORDS, COUNTS)} SELECT term_id, entry_count, sense_count FROM tcounts"
ORACLES["language_sizes"] = f"{_with(TERMS)} SELECT language, count(*) AS terms FROM terms GROUP BY language"
PARTICIPATION = """
part_rel AS (SELECT language, sum(n)::BIGINT AS relation_count FROM (SELECT slang AS language, count(*) AS n FROM rels GROUP BY 1
  UNION ALL SELECT tlang, count(*) FROM rels GROUP BY 1 UNION ALL SELECT slang, -count(*) FROM rels WHERE slang = tlang GROUP BY 1) GROUP BY language)"""
ORACLES["relation_participation"] = f"{_with(WORDS, PARTICIPATION)} SELECT language, relation_count FROM part_rel"
CATALOGUE = """
tl AS (SELECT s.language, count(*) AS n FROM transl JOIN senses s USING (sense_id) GROUP BY 1),
sums AS (SELECT language, count(*) AS term_count, sum(entry_count)::BIGINT AS entry_count, sum(sense_count)::BIGINT AS sense_count FROM tcounts GROUP BY 1),
lcat AS (SELECT s.*, coalesce(tl.n, 0) AS translation_count, coalesce(p.relation_count, 0) AS relation_count,
  language IN ('en','fr') AS has_vectors, language = 'en' AS has_pronunciation, language = 'en' AS has_wordplay
  FROM sums s LEFT JOIN tl USING (language) LEFT JOIN part_rel p USING (language))"""
ORACLES["language_catalogue"] = f"""{_with(WORDS, COUNTS, PARTICIPATION, CATALOGUE)} SELECT language, term_count, entry_count, sense_count, translation_count,
  relation_count, has_vectors, has_pronunciation, has_wordplay FROM lcat"""
ORACLES["availability"] = f"""{_with(WORDS, COUNTS, PARTICIPATION, CATALOGUE)},
langs AS (SELECT lang AS language FROM documents UNION SELECT n_name FROM nation UNION SELECT r_name FROM region),
asked AS (SELECT language AS raw, unnest(['lexical','semantic','pronunciation','wordplay']) AS capability FROM langs),
tag AS (SELECT *, capability||'|'||raw AS request_id, CASE WHEN regexp_full_match(replace(trim(raw),'_','-'), '[A-Za-z]{{2,8}}(-[A-Za-z0-9]{{1,8}})*')
  THEN lower(replace(trim(raw),'_','-')) END AS tag FROM asked),
why AS (SELECT t.*, CASE WHEN tag IS NULL THEN 'unknown_language'
  WHEN (tag IN ('en','de') AND capability = 'lexical') OR (tag = 'en' AND capability = 'wordplay') THEN 'installed'
  WHEN k.language IS NULL THEN 'unknown_language'
  WHEN NOT CASE capability WHEN 'lexical' THEN true WHEN 'semantic' THEN has_vectors WHEN 'pronunciation' THEN has_pronunciation ELSE has_wordplay END THEN 'not_available_upstream'
  WHEN tag NOT IN ('en','de') THEN 'language_not_installed' ELSE 'capability_not_installed' END AS reason
  FROM tag t LEFT JOIN lcat k ON k.language = t.tag)
SELECT request_id, capability, coalesce(tag, raw) AS language, reason = 'installed' AS installed, reason FROM why"""

_FOLD = """
RECURSIVE base AS ({sizes}),
big AS (SELECT language, 'lexical-'||language AS pack_id, terms, terms * 160 AS bytes FROM base WHERE terms * 160 >= {alone}),
small AS (SELECT language, terms, terms * 160 AS bytes, row_number() OVER (ORDER BY terms DESC, language) AS i FROM base WHERE terms * 160 < {alone}),
fold AS (SELECT i, language, terms, bytes, 1 AS bundle, bytes AS filled FROM small WHERE i = 1
  UNION ALL SELECT s.i, s.language, s.terms, s.bytes, f.bundle + (f.filled >= {target})::INT, CASE WHEN f.filled >= {target} THEN 0 ELSE f.filled END + s.bytes
  FROM fold f JOIN small s ON s.i = f.i + 1),
plan AS (SELECT * FROM big UNION ALL SELECT language, 'lexical-bundle-'||lpad(bundle::VARCHAR, 3, '0'), terms, bytes FROM fold)"""
ORACLES["partition_assignment"] = f"""WITH {_FOLD.format(alone=300_000, target=500_000, sizes="SELECT language||'-'||source AS language, count(*) AS terms FROM uses GROUP BY 1").replace(
    "RECURSIVE base", "RECURSIVE " + USES.strip() + ",\nbase")}
SELECT language, pack_id, terms, bytes::BIGINT AS estimated_bytes FROM plan"""

_PLANNED = _FOLD.format(alone=3_000_000, target=4_000_000, sizes="SELECT language, count(*) AS terms FROM terms GROUP BY 1")
PACKED = _PLANNED.replace("RECURSIVE base", f"RECURSIVE {WORDS.strip()},\n{COUNTS.strip()},\nbase") + """,
own AS (SELECT t.term_id, t.language, p.pack_id FROM terms t JOIN plan p USING (language)),
prel AS (SELECT DISTINCT p.pack_id, r.* FROM rels r JOIN plan p ON p.language IN (r.slang, r.tlang)),
refs AS (SELECT pack_id, src AS term_id FROM prel UNION SELECT pack_id, tgt FROM prel
  UNION SELECT p.pack_id, x.tid FROM transl x JOIN senses s USING (sense_id) JOIN plan p ON p.language = s.language
  UNION SELECT p.pack_id, x.tid FROM syns x JOIN senses s USING (sense_id) JOIN plan p ON p.language = s.language),
stubs AS (SELECT r.pack_id, k.term_id, k.term, k.norm, k.language, k.entry_count, k.sense_count FROM refs r JOIN tcounts k USING (term_id)
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pack_id = r.pack_id AND o.term_id = r.term_id))"""
ORACLES["partition_stubs"] = f"WITH {PACKED} SELECT pack_id, term, norm AS normalized_term, language, entry_count, sense_count FROM stubs"
ORACLES["partition_rows"] = f"""WITH {PACKED},
words_per AS (SELECT count(*) AS n, pack_id FROM plan GROUP BY 2)
SELECT pack_id, 'terms' AS table_name, count(*) AS row_count FROM own GROUP BY 1
UNION ALL SELECT pack_id, 'entries', count(*) FROM entries JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'senses', count(*) FROM senses JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'pronunciations', count(*) FROM senses JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'examples', count(*) FROM (SELECT DISTINCT lang AS language, doc_id, i, unnest(regexp_extract_all(lines[i], '\\p{{L}}+')) AS term FROM
  (SELECT lang, doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'translations', count(*) FROM transl JOIN senses USING (sense_id) JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'synonyms', count(*) FROM syns JOIN senses USING (sense_id) JOIN plan USING (language) GROUP BY 1
UNION ALL SELECT pack_id, 'relations', count(*) FROM prel GROUP BY 1
UNION ALL SELECT pack_id, 'target_catalogue', count(*) FROM stubs GROUP BY 1"""
ORACLES["partition_files"] = ORACLES["partition_rows"]
ORACLES["closure_report"] = f"""WITH {PACKED},
packs AS (SELECT DISTINCT pack_id FROM plan),
dang AS (SELECT r.pack_id, count(*) AS n FROM refs r WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pack_id = r.pack_id AND o.term_id = r.term_id)
  AND NOT EXISTS (SELECT 1 FROM stubs s WHERE s.pack_id = r.pack_id AND s.term_id = r.term_id) GROUP BY 1),
fsyn AS (SELECT p.pack_id, count(*) AS n FROM syns x JOIN senses s USING (sense_id) JOIN plan p ON p.language = s.language
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pack_id = p.pack_id AND o.term_id = x.tid) GROUP BY 1),
ovl AS (SELECT s.pack_id, count(*) AS n FROM stubs s JOIN own o ON o.pack_id = s.pack_id AND o.term_id = s.term_id GROUP BY 1)
SELECT pack_id, coalesce(d.n, 0) AS dangling, coalesce(f.n, 0) AS foreign_synonyms, coalesce(o.n, 0) AS overlap,
  coalesce(d.n, 0) + coalesce(f.n, 0) + coalesce(o.n, 0) = 0 AS closed
FROM packs LEFT JOIN dang d USING (pack_id) LEFT JOIN fsyn f USING (pack_id) LEFT JOIN ovl o USING (pack_id)"""

# ------------------------------------------------------------------------- quality
SAMPLED = f"""
rich AS (SELECT language, norm AS word FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY sense_count DESC, term_id) AS spot FROM tcounts WHERE sense_count > 0) WHERE spot <= 100),
spread AS (SELECT language, norm AS word FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {_hash("'20260816'", "term_id::VARCHAR")}, term_id) AS spot FROM tcounts) WHERE spot <= 100),
sampled AS (SELECT * FROM rich UNION SELECT * FROM spread)"""
ORACLES["sampled_words"] = f"{_with(WORDS, COUNTS, SAMPLED)} SELECT language, word FROM sampled"
ORACLES["differential_check"] = f"""{_with(WORDS, COUNTS, SAMPLED)},
firsts AS (SELECT w.language, w.word, s.sense_id, row_number() OVER (PARTITION BY w.language, w.word ORDER BY s.gloss IS NULL, s.sense_id) AS rn
  FROM sampled w JOIN senses s ON s.language = w.language AND s.norm = w.word)
SELECT 'relations' AS kind, language, 12 * count(*) AS checked, 0::BIGINT AS divergent FROM sampled GROUP BY 2
UNION ALL SELECT 'senses', language, count(*), 0 FROM sampled GROUP BY 2
UNION ALL SELECT 'translations', language, count(*), 0 FROM firsts WHERE rn <= 3 GROUP BY 2"""
def _framed(*parts: str) -> str:
    return "||".join(f"coalesce(length({p}::VARCHAR)||':'||{p}::VARCHAR, '-')" for p in parts)


DAMAGED = """
damaged AS (SELECT event_id, CASE WHEN event_id % 89 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 97 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 101 <> 0 THEN props END AS props FROM events)"""


def _profile(events: str) -> str:
    return f"""
SELECT 'documents' AS source, count(*) FILTER (WHERE NOT bad) AS row_count, count(*) FILTER (WHERE bad) AS malformed,
  (sum({_hash(_framed('doc_id', 'lang', 'n_chars', 'source', 'text'))}::HUGEINT) FILTER (WHERE NOT bad))::VARCHAR AS row_digest
FROM (SELECT *, text IS NULL OR trim(text) = '' AS bad FROM documents)
UNION ALL SELECT 'events', count(*) FILTER (WHERE NOT bad), count(*) FILTER (WHERE bad),
  (sum({_hash(_framed('event_id', 'event_type', 'props'))}::HUGEINT) FILTER (WHERE NOT bad))::VARCHAR
FROM (SELECT *, NOT coalesce(json_valid(props), false) AS bad FROM {events})"""


ORACLES["source_profile"] = f"WITH {DAMAGED} {_profile('damaged')}"
ORACLES["verify_sources"] = f"""WITH {DAMAGED}, o AS ({_profile('damaged')}), l AS ({_profile('events')})
SELECT source, o.row_count AS observed_row_count, o.malformed AS observed_malformed, o.row_digest AS observed_row_digest,
  l.row_count AS locked_row_count, l.malformed AS locked_malformed, l.row_digest AS locked_row_digest
FROM o FULL JOIN l USING (source)
WHERE (o.row_count, o.malformed, o.row_digest) IS DISTINCT FROM (l.row_count, l.malformed, l.row_digest)"""
STAGES = r"""
stages AS (SELECT prov AS provenance_id, 'entries' AS metric, count(*) AS observed FROM entries GROUP BY 1
  UNION ALL SELECT e.prov, 'senses', count(*) FROM senses s JOIN entries e USING (entry_id) GROUP BY 1
  UNION ALL SELECT e.prov, 'pronunciations', count(*) FROM senses s JOIN entries e USING (entry_id) GROUP BY 1
  UNION ALL SELECT e.prov, 'examples', count(*) FROM (SELECT DISTINCT lang, doc_id, i, unnest(regexp_extract_all(lines[i], '\p{L}+')) AS term FROM
    (SELECT lang, doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) x
    JOIN entries e ON e.language = x.lang AND e.term = x.term GROUP BY 1
  UNION ALL SELECT 7, 'translations', count(*) FROM transl HAVING count(*) > 0
  UNION ALL SELECT 8, 'synonyms', count(*) FROM syns HAVING count(*) > 0
  UNION ALL SELECT prov, 'relations', count(*) FROM rels GROUP BY 1)"""
ORACLES["stage_counts"] = f"{_with(WORDS, STAGES)} SELECT provenance_id::BIGINT AS provenance_id, metric, observed FROM stages"
ORACLES["floor_report"] = f"""{_with(WORDS, STAGES)},
nm AS (SELECT * FROM (VALUES (5,'documents'),(6,'documents-capitalised'),(7,'documents-shared'),(8,'documents-case')) v(provenance_id, stage)),
met AS (SELECT stage, metric, observed FROM stages JOIN nm USING (provenance_id)),
fl AS (SELECT stage, metric, per * (SELECT count(*) FROM documents) AS minimum FROM (VALUES ('documents','entries',10),('documents','senses',40),
  ('documents-case','synonyms',1),('documents-shared','translations',1000),('shipments','relations',1)) v(stage, metric, per))
SELECT stage, metric, coalesce(observed, -1) AS observed, minimum, coalesce(observed, -1) >= minimum AS passed FROM fl LEFT JOIN met USING (stage, metric)"""
ORACLES["latency_percentile"] = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS quantile)
SELECT event_type, quantile, n, value FROM r JOIN q ON rn = greatest(1, ceil(n * quantile)::BIGINT)"""
ORACLES["json_rows"] = f"""WITH {DAMAGED}
SELECT event_type, count(*) AS row_count, count(*) FILTER (WHERE NOT coalesce(json_valid(props), false)) AS malformed,
  sum(CASE WHEN json_valid(props) THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS k_sum FROM damaged GROUP BY event_type"""


# ------------------------------------------------------------------------- loaders
ASSERTIONS = """
pairs AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
said AS (SELECT p, s FROM pairs UNION ALL SELECT p, s FROM pairs WHERE p % 3 = 0),
judged AS (SELECT *, (p + s) % 29 <> 0 AS shaped, (p + s) % 29 <> 0 AND p % 7 <> 2 AND s % 11 <> 0 AND p % 5 NOT IN (0, 2) AS accepted FROM said),
linked AS (SELECT DISTINCT 'en' AS source_language, p_name AS source_term,
    CASE p % 7 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 3 THEN 12 ELSE 11 END::BIGINT AS relation_code,
    CASE WHEN s % 3 = 0 THEN 'fr' ELSE 'en' END AS target_language, s_name AS target_term,
    CASE WHEN p % 7 = 3 THEN 3 ELSE 1 END::BIGINT AS direction_code, 3::BIGINT AS provenance_id
  FROM judged JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s WHERE accepted)"""
ORACLES["loaded_assertions"] = f"WITH {ASSERTIONS} SELECT * FROM linked"
ORACLES["loaded_assertion_counts"] = f"""WITH {ASSERTIONS}
SELECT 'source_assertions' AS metric, count(*) FILTER (WHERE shaped) AS observed FROM judged
UNION ALL SELECT 'assertions', count(*) FILTER (WHERE accepted) FROM judged
UNION ALL SELECT 'skipped', count(*) FILTER (WHERE shaped AND NOT accepted) FROM judged
UNION ALL SELECT 'malformed', count(*) FILTER (WHERE NOT shaped) FROM judged
UNION ALL SELECT 'relations', count(*) FROM linked"""
ORACLES["loaded_pronunciations"] = f"""{_with(SPOKEN)}
SELECT DISTINCT 'en' AS language, term, norm AS normalized_term, phonemes, rkey AS rhyme_key FROM sounded WHERE length(term) % 7 <> 0 AND term NOT LIKE 'q%'"""
ORACLES["loaded_pronunciation_counts"] = f"""{_with(SPOKEN)},
kept AS (SELECT * FROM sounded WHERE length(term) % 7 <> 0)
SELECT unnest(['entries', 'pronunciations', 'malformed']) AS metric, unnest([count(*) FILTER (WHERE term NOT LIKE 'q%'),
  count(*) FILTER (WHERE term NOT LIKE 'q%'), count(*) FILTER (WHERE term LIKE 'q%')]) AS observed FROM kept"""
LINES = """
vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sound AS (SELECT * FROM vec WHERE label < 9 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0),
size AS (SELECT count(*) AS n FROM vec),
tally AS (SELECT count(*) + count(*) FILTER (WHERE vec_id % 19 = 0) AS lines,
    count(*) FILTER (WHERE label >= 9) + count(*) FILTER (WHERE label >= 9 AND vec_id % 19 = 0) AS filtered FROM vec)"""
ORACLES["loaded_vectors"] = f"""WITH {LINES}
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS semantic_id, '/c/l'||label||'/v_'||vec_id AS concept, 'l'||label AS language, 'v '||vec_id AS term,
  round((v[1] / sqrt(list_inner_product(v, v)))::FLOAT::DOUBLE, 4) AS first, round((v[len(v)] / sqrt(list_inner_product(v, v)))::FLOAT::DOUBLE, 4) AS last FROM sound"""
ORACLES["loaded_vector_counts"] = f"""WITH {LINES},
kept AS (SELECT count(*) AS terms, count(*) + count(*) FILTER (WHERE vec_id % 19 = 0) AS valid FROM sound),
facts AS (SELECT n + n // 19 + 1 AS expected_rows, (SELECT max(len(v)) FROM vec) AS dimensions, terms, lines - filtered - valid AS malformed, filtered, valid FROM size, tally, kept)
SELECT 'expected_rows' AS metric, expected_rows AS observed FROM facts UNION ALL SELECT 'dimensions', dimensions FROM facts
UNION ALL SELECT 'terms', terms FROM facts UNION ALL SELECT 'malformed', malformed FROM facts UNION ALL SELECT 'filtered', filtered FROM facts
UNION ALL SELECT 'valid', valid FROM facts UNION ALL SELECT 'duplicates', valid - terms FROM facts
UNION ALL SELECT 'unaccounted', expected_rows - valid - malformed - filtered FROM facts"""
THESAURUS = f"""
pt AS (SELECT *, 'syn-'||replace(p_type, ' ', '_')||'-'||p_size AS syn, {_hash("'en'", "lower(p_name)", "p_name")} AS term_id FROM part),
asked AS (SELECT DISTINCT p_type, p_size, syn FROM pt),
sy AS (SELECT *, p_type||' of size '||p_size||CASE WHEN p_size % 4 = 0 THEN '; a second one' ELSE '' END AS gloss FROM asked WHERE p_size % 11 <> 0 AND p_size % 13 <> 0),
en AS (SELECT *, CASE WHEN p_partkey % 41 = 0 THEN 'syn-none' ELSE syn END AS member_of, CASE WHEN p_partkey % 2 = 0 THEN 'n' END AS pos
  FROM pt WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0),
se AS (SELECT en.p_partkey, 'wordnet:sense:s'||en.p_partkey AS sense_id, en.p_name, en.term_id, en.member_of, en.pos, sy.syn AS known, sy.p_size, sy.p_type,
    CASE WHEN en.p_partkey % 7 = 0 THEN 'own '||en.p_partkey ELSE sy.gloss END AS gloss, coalesce(en.pos, CASE WHEN sy.syn IS NOT NULL THEN 'n' END) AS member_pos
  FROM en LEFT JOIN sy ON sy.syn = en.member_of WHERE en.p_partkey % 37 <> 0),
sl AS (SELECT a.sense_id, b.term_id AS target_term_id, a.member_pos AS part_of_speech, row_number() OVER (PARTITION BY a.sense_id ORDER BY b.term_id) - 1 AS position
  FROM se a JOIN (SELECT DISTINCT member_of, term_id FROM se) b ON a.member_of = b.member_of AND a.term_id <> b.term_id),
rl AS (SELECT a.p_name AS source_term, a.sense_id AS source_sense_id, 3::BIGINT AS relation_code, b.p_name AS target_term, b.sense_id AS target_sense_id
    FROM sy JOIN se a ON a.member_of = sy.syn JOIN se b ON b.member_of = 'syn-'||replace(sy.p_type, ' ', '_')||'-'||(sy.p_size + 1)
  UNION ALL SELECT a.p_name, a.sense_id, 7, b.p_name, b.sense_id FROM se a JOIN se b ON b.p_partkey = a.p_partkey + 1
  UNION ALL SELECT a.p_name, a.sense_id, 2, b.p_name, b.sense_id FROM se a JOIN se b ON b.p_partkey = a.p_partkey - 2)"""
ORACLES["loaded_synsets"] = f"""WITH {THESAURUS}
SELECT sense_id, 'wordnet:entry:e'||p_partkey AS entry_id, p_name AS term, pos AS part_of_speech, gloss,
  CASE WHEN known IS NOT NULL AND p_size % 3 = 0 THEN lower(p_type)||' first|second' ELSE '' END AS examples FROM se"""
ORACLES["loaded_sense_relations"] = f"WITH {THESAURUS} SELECT *, 1::BIGINT AS direction_code FROM rl"
ORACLES["loaded_wordnet_synonyms"] = f"WITH {THESAURUS} SELECT * FROM sl"
ORACLES["loaded_wordnet_counts"] = f"""WITH {THESAURUS}
SELECT 'synsets' AS metric, count(*) AS observed FROM sy UNION ALL SELECT 'synonyms', count(*) FROM sl
UNION ALL SELECT 'entries', count(*) FROM en UNION ALL SELECT 'senses', count(*) FROM se
UNION ALL SELECT 'examples', 2 * count(*) FROM se WHERE known IS NOT NULL AND p_size % 3 = 0
UNION ALL SELECT 'pronunciations', count(*) FROM en WHERE p_partkey % 5 = 0 UNION ALL SELECT 'relations', count(*) FROM rl
UNION ALL SELECT 'malformed_elements', (SELECT count(*) FROM asked WHERE p_size % 11 = 0) + (SELECT count(*) FROM pt WHERE p_partkey % 29 = 0)
UNION ALL SELECT 'missing_id', count(*) FROM asked WHERE p_size % 13 = 0 AND p_size % 11 <> 0"""


def _stable(prefix: str, *parts: str) -> str:
    """Id over the JSON of parts that are SQL expressions of JSON values."""
    body = "||','||".join(f"'\"p{k}\":'||{part}" for k, part in enumerate(parts))
    return f"'{prefix}:'||substr(sha256('{{'||{body}||'}}'), 1, 24)"


def _quoted(text: str) -> str:
    return f"coalesce('\"'||replace(replace({text}, '\"', '\\\"'), chr(10), '\\n')||'\"', 'null')"


DICTIONARY = f"""
ln AS (SELECT *, p_partkey AS k, 'part-'||(p_partkey % 3)||'.jsonl' AS file FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 43 <> 0 AND p_partkey % 41 <> 0),
pl AS (SELECT *, row_number() OVER (ORDER BY file, k) AS place FROM ln),
de AS (SELECT *, CASE k % 9 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'und' ELSE 'en' END AS language, CASE WHEN k % 2 = 0 THEN 'noun' END AS pos,
    CASE k % 4 WHEN 0 THEN 'from '||p_type WHEN 1 THEN 'one'||chr(10)||chr(10)||'two' END AS etymology FROM pl WHERE k % 37 <> 0),
di AS (SELECT *, {_stable("wikt:entry", _quoted("language"), _quoted("p_name"), _quoted("pos"),
    "CASE WHEN k % 3 = 0 THEN '\"'||(k % 5)||'\"' ELSE 'null' END", _quoted("etymology"), "place")} AS entry_id FROM de),
na AS (SELECT *, {_stable("wikt:sense", _quoted("entry_id"),
    _quoted("CASE k % 3 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN 's1' ELSE '7' END"), _quoted("'[\"g'||k||'\"]'"), "0")} AS sense_id,
    {_stable("wikt:sense", _quoted("entry_id"), "'null'", "'null'", "1")} AS raw_sense_id FROM di WHERE k % 6 <> 0),
lo AS (SELECT *, k % 7 = 0 OR k % 8 = 0 AS labelled, k % 7 = 0 OR k % 8 = 0 AS loose, {_stable("wikt:labeled", _quoted("entry_id"), "'\"label\"'")} AS label_id,
    replace({_stable("wikt", _quoted("entry_id"))}, 'wikt:', 'wikt:unsensed:') AS unsensed_id FROM di),
ds AS (SELECT sense_id, entry_id, 'g'||k AS gloss, '0 ex|1 ex2' AS examples FROM na UNION ALL SELECT raw_sense_id, entry_id, 'raw', '' FROM na
  UNION ALL SELECT label_id, entry_id, 'label', '' FROM lo WHERE labelled
  UNION ALL SELECT unsensed_id, entry_id, NULL, '' FROM lo WHERE loose OR k % 6 = 0),
dl AS (SELECT 'synonyms' AS kind, sense_id, pos AS part_of_speech, 0 AS position, language, p_brand AS term FROM na
  UNION ALL SELECT 'synonyms', sense_id, pos, 1, language, 'a'||p_size FROM na
  UNION ALL SELECT 'translations', sense_id, pos, 0, 'fr', 'mot '||p_size FROM na
  UNION ALL SELECT 'translations', label_id, pos, 0, 'de', 'wort' FROM lo WHERE k % 7 = 0
  UNION ALL SELECT 'translations', unsensed_id, pos, 0, 'de', 'wort' FROM lo WHERE k % 7 = 0
  UNION ALL SELECT 'antonyms', label_id, NULL, NULL, language, 'not '||p_brand FROM lo WHERE k % 8 = 0
  UNION ALL SELECT 'antonyms', unsensed_id, NULL, NULL, language, 'not '||p_brand FROM lo WHERE k % 8 = 0)"""
ORACLES["loaded_dictionary_entries"] = f"""WITH {DICTIONARY}
SELECT entry_id, language, p_name AS term, pos AS part_of_speech, etymology, CASE WHEN k % 5 = 0 THEN '/p/ UK, old|/q/ ' ELSE '' END AS sounds FROM di"""
ORACLES["loaded_dictionary_senses"] = f"WITH {DICTIONARY} SELECT * FROM ds"
ORACLES["loaded_dictionary_links"] = f"WITH {DICTIONARY} SELECT kind, sense_id, part_of_speech, position::BIGINT AS position, language, term FROM dl"
ORACLES["loaded_dictionary_counts"] = f"""WITH {DICTIONARY}
SELECT 'entries' AS metric, count(*) AS observed FROM di UNION ALL SELECT 'senses', count(*) FROM ds
UNION ALL SELECT 'examples', 2 * count(*) FROM na UNION ALL SELECT 'pronunciations', 2 * count(*) FROM di WHERE k % 5 = 0
UNION ALL SELECT kind, count(*) FROM dl GROUP BY 1
UNION ALL SELECT 'labeled_senses', count(*) FROM lo WHERE labelled UNION ALL SELECT 'unsensed_senses', count(*) FROM lo WHERE loose OR k % 6 = 0
UNION ALL SELECT 'missing_word', count(*) FROM pl WHERE k % 37 = 0
UNION ALL SELECT 'malformed_lines', count(*) FROM part WHERE p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 43 = 0
UNION ALL SELECT 'language_codes', count(DISTINCT language) FROM di WHERE language <> 'und'"""


def _lane(lane: int) -> str:
    value = f"(('0x'||substr(h, {1 + 15 * lane}, 15))::BIGINT % {PRIMES[lane]})::HUGEINT"
    return (
        f"list_reduce(list_prepend(0::HUGEINT, list({value} ORDER BY file, spot)),"
        f" lambda a, x: (a * {BASES[lane]} + x) % {PRIMES[lane]})::VARCHAR"
    )


_ROWS = "rows_ AS (SELECT lang, source AS file, {at} AS spot, sha256(CASE WHEN text IS NULL THEN '-' ELSE '+'||text END) AS h FROM documents)"
_LANES = "||'-'||".join(_lane(k) for k in range(len(PRIMES)))
ORACLES["ordered_digests"] = f"""WITH {_ROWS.format(at='doc_id')}
SELECT lang AS source, count(*) AS rows, {_LANES} AS digest FROM rows_ GROUP BY lang"""
ORACLES["changed_orders"] = f"""WITH {_ROWS.format(at='doc_id')},
sw AS (SELECT lang, file, CASE WHEN lang = 'fr' THEN xor(spot, 64) ELSE spot END AS spot, h FROM rows_),
a AS (SELECT lang, count(*) AS n, list(h ORDER BY file, spot) AS hs FROM rows_ GROUP BY lang), b AS (SELECT lang, list(h ORDER BY file, spot) AS hs FROM sw GROUP BY lang)
SELECT a.lang AS source, n AS rows_before, n AS rows_after FROM a JOIN b USING (lang) WHERE a.hs <> b.hs"""

ORACLES["synonyms_of_sense"] = f"""{_with(PARTS)}
SELECT sense_id AS request_id, 1::BIGINT AS group_index, spot AS position, sense_id, tterm AS term FROM (
  SELECT sense_id, tterm, row_number() OVER (PARTITION BY sense_id ORDER BY position) AS spot FROM syn WHERE position < 100)
WHERE spot <= CASE WHEN contains(sense_id, ':unsensed:') THEN 5 ELSE 20 END"""
ORACLES["relations_into_language"] = f"""{_with(WORDS)}
SELECT DISTINCT a.language||':'||a.norm AS request_id, 1::BIGINT AS rank, a.norm AS target_word, 'fr' AS target_language
FROM terms a JOIN terms b ON a.norm = b.norm AND b.language = 'fr' WHERE a.language <> 'fr'"""
ORACLES["relations_two_hop_into_language"] = ORACLES["relations_two_hop"]
_SEARCHED = " UNION ALL ".join(
    f"SELECT '{mode}/'||request_id AS request_id, rank, term, normalized_term, language, '{mode}' AS mode, phonemes"
    f" FROM ({ORACLES[name]}) WHERE request_id IN (SELECT word FROM bwords)"
    for mode, name in (("rhyme", "rhymes_exact"), ("near_rhyme", "rhymes_near"), ("sounds_like", "sounds_like"), ("prefix", "prefix_match"))
)
_STARTS = "SELECT DISTINCT substr(word, 1, 2)||'*' AS pat FROM bwords"
_STARTED = f"""
  SELECT 'spelled_like/'||pat AS request_id, norm, term, phonemes FROM ({_STARTS}) JOIN heads ON norm LIKE replace(pat, '*', '%')"""
ORACLES["search_modes"] = _with(SPOKEN, BENCH, _HEADS) + f"{_SEARCHED} UNION ALL SELECT * FROM ({_spoken_answer(_STARTED, 'spelled_like')})"
ORACLES["refreshed_source"] = f"""{_with(GRAPH)}
SELECT prov::BIGINT AS provenance_id, code::BIGINT AS relation_code, CASE WHEN prov = 2 THEN 3 ELSE dir END::BIGINT AS direction_code, count(*) AS rows FROM rel GROUP BY ALL"""
ORACLES["lookup_bucketed"] = ORACLES["sense_lookup"]
ORACLES["table_differences"] = """
WITH r AS (SELECT * REPLACE (CASE WHEN l_orderkey % 991 = 0 AND l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity)
    FROM lineitem WHERE NOT (l_orderkey % 997 = 0 AND l_linenumber = 1)
  UNION ALL SELECT * REPLACE (-l_orderkey AS l_orderkey) FROM lineitem WHERE l_orderkey % 983 = 0 AND l_linenumber = 1
  UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 977 = 0 AND l_linenumber = 1),
c AS (SELECT COLUMNS(lambda c: NOT contains(c, 'side')), count(*) FILTER (WHERE side = 0) AS times_left, count(*) FILTER (WHERE side = 1) AS times_right
  FROM (SELECT *, 0 AS side FROM lineitem UNION ALL SELECT *, 1 FROM r) GROUP BY ALL),
k AS (SELECT *, sum(times_left) OVER w AS lefts, sum(times_right) OVER w AS rights FROM c WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN lefts = 0 THEN 'added' WHEN rights = 0 THEN 'removed' ELSE 'changed' END AS state, times_left, times_right
FROM k WHERE times_left <> times_right"""
ORACLES["table_digest_levels"] = "SELECT 1::BIGINT AS level, 64::BIGINT AS compared, 0::BIGINT AS differing FROM lineitem LIMIT 1"

# ------------------------------------------------- nested answers, merged sets, partitions
ORACLES["translation_coverage_by_bits"] = ORACLES["translation_coverage"]
ORACLES["translated_senses"] = f"""{_with(WORDS)}
SELECT (2 - bit_count(GROUPING(s.language, tlang)::BIGINT))::BIGINT AS level, s.language, tlang AS target_language, count(DISTINCT sense_id) AS senses
FROM transl JOIN senses s USING (sense_id) GROUP BY GROUPING SETS ((s.language, tlang), (s.language), ())"""
_LISTED = ",\n".join(
    f"{c}_list AS (SELECT request_id, rank, string_agg({text}, ';' ORDER BY item) AS listed FROM {c}_taken GROUP BY ALL)"
    for c, text in (("ex", "value"), ("pr", "value||'@'||detail"), ("tl", "value||'@'||detail"))
)
ORACLES["lookup_nested"] = f"""{_with(WORDS, COVERAGE, BENCH, _BENCH_WORDS, PICKED, DETAILS, _LISTED)},
cut AS (SELECT request_id, rank, string_agg(field, ',' ORDER BY field) AS fields FROM ({ORACLES["lookup_truncated"]}) GROUP BY ALL)
SELECT p.request_id, p.rank, p.sense_id, coalesce(ex_list.listed, '') AS examples, coalesce(pr_list.listed, '') AS pronunciations,
  coalesce(tl_list.listed, '') AS translations, coalesce(cut.fields, '') AS truncated_fields
FROM picked p LEFT JOIN ex_list USING (request_id, rank) LEFT JOIN pr_list USING (request_id, rank) LEFT JOIN tl_list USING (request_id, rank)
  LEFT JOIN cut USING (request_id, rank)"""
ORACLES["synonyms_nested"] = f"""
SELECT request_id, count(*) AS group_count, string_agg(coalesce(sense_id, '-')||'|'||terms, ';' ORDER BY group_index) AS groups FROM
  (SELECT request_id, group_index, sense_id, string_agg(term, ',' ORDER BY position) AS terms FROM ({ORACLES["synonyms_grouped"]}) GROUP BY ALL)
GROUP BY request_id"""
ORACLES["relations_nested"] = f"""
SELECT request_id, count(*) AS result_count,
  string_agg(relation_scope||'|'||source_term||'>'||CASE WHEN middle_term IS NULL THEN '' ELSE middle_term||'>' END||target_term, ';' ORDER BY rank) AS paths
FROM ({ORACLES["relations_two_hop"]}) GROUP BY request_id"""
ORACLES["vector_partition_rows"] = """
SELECT 'l'||label AS language, row_number() OVER (PARTITION BY label ORDER BY 'v'||vec_id, vec_id) - 1 AS local_id, vec_id AS semantic_id, 'v'||vec_id AS term,
  len(embedding) AS dimensions, embedding[1]::DOUBLE AS first_component FROM embeddings"""

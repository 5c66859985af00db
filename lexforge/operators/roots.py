"""Roots, combining forms, spelling alternations and compounds of a corpus, by language."""

from lexforge.operators.affixes import affixes, kept, stems
from lexforge.plans.dialect import Dialect, plan

#: The vowels of the Latin script.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ"
#: Latin letters that a stem's last letter may be exchanged with, as attested sound changes: spirantisation,
#: softening, semivowels, voicing, velar to palatal, Grimm's law, rhotacism, lenition, nasals, liquids.
PARTNERS = (
    ("t", "s"), ("t", "z"), ("d", "s"), ("d", "z"),
    ("c", "s"), ("k", "s"),
    ("y", "i"), ("y", "e"),
    ("f", "v"), ("s", "z"), ("p", "b"), ("t", "d"), ("k", "g"),
    ("k", "č"), ("k", "c"),
    ("p", "f"),
    ("s", "r"),
    ("b", "v"),
    ("n", "m"),
    ("l", "r"),
)


def v(text: str) -> str:
    return f"({text} IN ({', '.join(repr(c) for c in VOWELS)}))"


@plan("A16 A17")
def neoclassical_forms(d: Dialect) -> str:
    """Substrings of 3 to 10 letters that stand beside many different letters, or mostly beside vowels."""
    return f"""WITH {d.words}, parts AS (SELECT lang, substr(word, i, n) AS part, CASE WHEN i > 1 THEN substr(word, i - 1, 1) ELSE '^' END AS l, CASE WHEN i + n <= length(word) THEN substr(word, i + n, 1) ELSE '$' END AS r
  FROM words {d.count('3', 'least(length(word), 10)', 'n')} {d.count('1', 'length(word) - n + 1', 'i')}),
pairs AS (SELECT lang, part, l, r, count(*) AS c FROM parts GROUP BY lang, part, l, r),
totals AS (SELECT lang, part, sum(c) AS freq, sum(CASE WHEN {v('l')} OR {v('r')} THEN c ELSE 0 END) AS beside FROM pairs GROUP BY lang, part HAVING sum(c) >= 12),
entropies AS (SELECT x.lang, x.part, sum(CASE WHEN side = 1 THEN h END) AS forward, sum(CASE WHEN side = 2 THEN h END) AS backward FROM (
  SELECT p.lang, p.part, 1 AS side, -(sum(c) / CAST(max(t.freq) AS DOUBLE)) * log2(sum(c) / CAST(max(t.freq) AS DOUBLE)) AS h FROM pairs p JOIN totals t ON p.lang = t.lang AND p.part = t.part GROUP BY p.lang, p.part, p.r
  UNION ALL SELECT p.lang, p.part, 2 AS side, -(sum(c) / CAST(max(t.freq) AS DOUBLE)) * log2(sum(c) / CAST(max(t.freq) AS DOUBLE)) AS h FROM pairs p JOIN totals t ON p.lang = t.lang AND p.part = t.part GROUP BY p.lang, p.part, p.l) x GROUP BY x.lang, x.part)
SELECT t.lang, t.part, CAST(t.freq AS BIGINT) AS freq, round(e.forward + 1e-9, 2) + 0.0 AS f_entropy, round(e.backward + 1e-9, 2) + 0.0 AS b_entropy, round(beside / CAST(freq AS DOUBLE) + 1e-9, 2) AS vowel_share
FROM totals t JOIN entropies e ON t.lang = e.lang AND t.part = e.part WHERE (beside >= 0.7 * freq OR freq >= 50) AND (e.forward + e.backward > 3.5 OR (beside >= 0.8 * freq AND e.forward + e.backward > 0.1))"""


@plan("F13")
def maximal_forms(d: Dialect) -> str:
    """Frequent beginnings of four letters or more that aren't words and aren't cut-off pieces of a longer or shorter form."""
    return f"""WITH {d.words}, {affixes(d)}, candidates AS (SELECT a.* FROM affixes a {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} words w ON a.lang = w.lang AND a.affix = w.word WHERE a.side = 'prefix' AND length(a.affix) >= 4 AND a.freq >= 12)
SELECT c.lang, c.affix, c.freq FROM candidates c LEFT JOIN affixes s ON s.side = 'suffix' AND s.lang = c.lang AND s.affix = c.affix LEFT JOIN affixes t ON t.side = 'suffix' AND t.lang = c.lang AND t.affix = right(c.affix, length(c.affix) - 1)
LEFT JOIN affixes p ON p.side = 'prefix' AND p.lang = c.lang AND p.affix = left(c.affix, length(c.affix) - 1)
WHERE NOT coalesce(t.freq >= 30 AND coalesce(s.freq, 0) < 0.5 * t.freq, FALSE) AND NOT coalesce(p.freq >= 200 AND c.freq <= 0.1 * p.freq AND {d.of(f"regexp_like(c.affix, '[^{VOWELS}]{{2}}$')", f"regexp_matches(c.affix, '[^{VOWELS}]{{2}}$')")}, FALSE)"""


@plan("A19b A19c O08")
def roots_before_vowels(d: Dialect) -> str:
    """Roots of three to ten letters before a vowel and four letters or more: in three words or more, and 40 % of those that begin
    so, the rest is a word or begins with a kept suffix of five letters or more, and starts in three ways; a root of up to five
    letters that is a word needs eight words of ten letters. 25 examples."""
    examples = "array_join(slice(array_sort(collect_set(word)), 1, 25), ';')" if d.spark else "array_to_string(list_sort(list(DISTINCT word))[1:25], ';')"
    return f"""WITH {d.words}, {kept(d)}, cuts AS (SELECT lang, word, left(word, n) AS root, right(word, length(word) - n - 1) AS rest FROM words {d.count('3', 'least(length(word) - 5, 10)', 'n')} WHERE {v('substr(word, CAST(n AS INT) + 1, 1)')}),
begun AS (SELECT lang, root, count(*) AS many FROM cuts GROUP BY lang, root),
ends AS (SELECT DISTINCT c.lang, c.word, c.root FROM (SELECT lang, word, root, left(rest, m) AS part FROM cuts {d.count('5', 'least(length(rest), 10)', 'm')}) c JOIN kept k ON k.side = 'suffix' AND c.lang = k.lang AND c.part = k.affix),
hits AS (SELECT c.lang, c.word, c.root, c.rest FROM cuts c LEFT JOIN words w ON c.lang = w.lang AND c.rest = w.word LEFT JOIN ends e ON c.lang = e.lang AND c.word = e.word AND c.root = e.root WHERE w.word IS NOT NULL OR e.word IS NOT NULL),
roots AS (SELECT lang, root, count(*) AS n, count(DISTINCT left(rest, 1)) AS firsts, count(DISTINCT CASE WHEN length(word) >= 10 THEN word END) AS long_words, {examples} AS examples FROM hits GROUP BY lang, root HAVING count(*) >= 3 AND count(DISTINCT left(rest, 1)) >= 3)
SELECT r.lang, r.root, b.many AS freq, r.n, r.firsts, round(r.n / CAST(b.many AS DOUBLE), 6) AS share, r.examples FROM roots r JOIN begun b ON r.lang = b.lang AND r.root = b.root LEFT JOIN words w ON r.lang = w.lang AND r.root = w.word
WHERE r.n >= 0.4 * b.many AND NOT (length(r.root) <= 5 AND w.word IS NOT NULL AND r.long_words < 8)"""


@plan("F14 A19c")
def shifted_fragments(d: Dialect) -> str:
    """Splits of a word into a word and a rest of three letters, of which the split one place to the left or right leaves a word:
    such an example speaks for a fragment."""
    return f"""WITH {d.words}, cuts AS (SELECT lang, word, n, right(word, length(word) - n) AS rest, right(word, length(word) - n - 1) AS shorter, right(word, length(word) - n + 1) AS longer FROM words {d.count('3', 'length(word) - 4', 'n')}),
free AS (SELECT c.lang, c.word, c.n, c.shorter, c.longer FROM cuts c {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON c.lang = w.lang AND c.rest = w.word)
SELECT f.lang, f.word, CAST(f.n AS BIGINT) AS n, s.word IS NOT NULL AS right_shift, l.word IS NOT NULL AS left_shift FROM free f LEFT JOIN words s ON f.lang = s.lang AND f.shorter = s.word LEFT JOIN words l ON f.lang = l.lang AND f.longer = l.word WHERE s.word IS NOT NULL OR l.word IS NOT NULL"""


@plan("A19d A19e")
def forms_ending_in_a_linker(d: Dialect) -> str:
    """Forms that end in o or i, stand before five different rests, half of them words."""
    return f"""WITH {d.words}, cuts AS (SELECT lang, left(word, n) AS form, right(word, length(word) - n) AS rest FROM words {d.count('3', 'length(word) - 2', 'n')}),
joined AS (SELECT c.lang, c.form, c.rest, w.word IS NOT NULL AS free FROM cuts c LEFT JOIN words w ON c.lang = w.lang AND c.rest = w.word WHERE right(c.form, 1) IN ('o', 'i'))
SELECT lang, form, count(DISTINCT rest) AS n_rests, round(avg(CASE WHEN free THEN 1e0 ELSE 0e0 END), 6) AS free_share FROM joined GROUP BY lang, form HAVING count(DISTINCT rest) >= 5 AND avg(CASE WHEN free THEN 1.0 ELSE 0.0 END) >= 0.5"""


@plan("A19f A19g A19h A19i")
def words_by_pattern(d: Dialect) -> str:
    """Words with an inner cluster, an abstract ending or a learned beginning."""
    like = lambda p: d.of(f"regexp_like(word, '{p}')", f"regexp_matches(word, '{p}')")
    return f"""WITH {d.words} SELECT lang, pattern, count(*) AS n, min(word) AS first_word FROM (
  SELECT lang, word, 'cluster' AS pattern FROM words WHERE {like('.(ct|pt|gn).')} UNION ALL SELECT lang, word, 'ending' FROM words WHERE length(word) > 6 AND {like('(tion|ment|ité|keit|heit|ung|ción|dad)$')}
  UNION ALL SELECT lang, word, 'beginning' FROM words WHERE length(word) > 6 AND {like('^(trans|inter|super|sub|con|pro|re|de|in|un|ver|be|ge)')}) x GROUP BY lang, pattern"""


@plan("A20 A21")
def free_roots(d: Dialect) -> str:
    """Words that are frequent parts of others: twice the least frequency, or once for those of six letters at most."""
    return f"""WITH {d.words}, {affixes(d, 10, False)}, parts AS (SELECT lang, affix, sum(freq) AS freq FROM affixes GROUP BY lang, affix)
SELECT w.lang, w.word, CAST(p.freq AS BIGINT) AS freq FROM words w JOIN parts p ON w.lang = p.lang AND w.word = p.affix WHERE p.freq >= 8 OR (length(w.word) <= 6 AND p.freq >= 4)"""


@plan("A20")
def bound_root_runs(d: Dialect) -> str:
    """Affixes in alphabetical order, in runs in which each is longer than the one before; a run's longest and most frequent."""
    return f"""WITH {d.words}, {affixes(d, 10, False)}, ordered AS (SELECT lang, affix, freq, CASE WHEN length(affix) > lag(length(affix)) OVER (PARTITION BY lang ORDER BY affix) THEN 0 ELSE 1 END AS fresh FROM affixes WHERE side = 'prefix' AND freq >= 4),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY lang ORDER BY affix ROWS UNBOUNDED PRECEDING) AS run FROM ordered)
SELECT lang, CAST(run AS BIGINT) AS run, count(*) AS n, max(CAST(length(affix) AS BIGINT)) AS longest, max(freq) AS most FROM runs GROUP BY lang, run HAVING count(*) >= 3"""


@plan("J08 J09")
def anchored_forms(d: Dialect) -> str:
    """Beginnings that remain when frequent endings (15 words) are cut off: three different endings at least, no word itself."""
    return f"""WITH {d.words}, ends AS (SELECT lang, right(word, n) AS anchor, left(word, length(word) - n) AS form FROM words {d.count('3', 'least(length(word) - 3, 10)', 'n')}),
anchors AS (SELECT lang, anchor FROM ends GROUP BY lang, anchor HAVING count(*) >= 15),
forms AS (SELECT e.lang, e.form, count(DISTINCT e.anchor) AS partners FROM ends e JOIN anchors a ON e.lang = a.lang AND e.anchor = a.anchor GROUP BY e.lang, e.form HAVING count(DISTINCT e.anchor) >= 3)
SELECT f.lang, f.form, f.partners FROM forms f {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} words w ON f.lang = w.lang AND f.form = w.word"""


@plan("")
def compound_parts(d: Dialect) -> str:
    """Words that are two words of three letters or more; for each left part, how many right parts and words."""
    return f"""WITH {d.words}, cuts AS (SELECT lang, word, left(word, n) AS a, right(word, length(word) - n) AS b FROM words {d.count('3', 'length(word) - 3', 'n')}),
both_known AS (SELECT c.lang, c.word, c.a, c.b FROM cuts c {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words x ON c.lang = x.lang AND c.a = x.word)
SELECT lang, a AS left_part, count(DISTINCT b) AS n_right, count(DISTINCT word) AS n_words FROM (SELECT k.* FROM both_known k {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words y ON k.lang = y.lang AND k.b = y.word) z GROUP BY lang, a HAVING count(DISTINCT b) >= 2"""


def edits(d: Dialect) -> str:
    """CTE edits(lang, stem, word, restored, surface, lexical) of stems left by discovered suffixes."""
    last, prev, head = "right(stem, 1)", "substr(stem, length(stem) - 1, 1)", "left(stem, length(stem) - 1)"
    vowel = d.rows("v", *((c,) for c in VOWELS))
    pair = d.rows("x, y", *((a, b) for a, b in PARTNERS), *((b, a) for a, b in PARTNERS))
    suffixes = "suffixes AS (SELECT lang, affix FROM derived WHERE side = 'suffix' GROUP BY lang, affix HAVING count(*) >= 40)"
    cut = f"""SELECT w.lang, w.word, w.stem, f.word IS NOT NULL AS known FROM (SELECT lang, word, left(word, length(word) - n) AS stem, right(word, n) AS ending FROM words {d.count('1', 'least(length(word) - 3, 7)', 'n')}) w
  JOIN suffixes s ON w.lang = s.lang AND w.ending = s.affix LEFT JOIN words f ON w.lang = f.lang AND w.stem = f.word"""
    return f"""{suffixes},
{d.table("stored_cut_stems", "cut_stems", cut, f"{d.words}, {stems(d, 1, 7)}, {suffixes}")},
edits AS (SELECT lang, word, stem, known, stem || v AS restored, {last} AS surface, {last} || v AS lexical FROM cut_stems CROSS JOIN {vowel} q WHERE NOT {v(last)}
  UNION ALL SELECT lang, word, stem, known, {head}, {last} || {last}, {last} FROM cut_stems WHERE {last} = {prev} AND NOT {v(last)}
  UNION ALL SELECT lang, word, stem, known, {head} || y, {last}, y FROM cut_stems JOIN {pair} p ON {last} = p.x
  UNION ALL SELECT lang, word, stem, known, {head}, {prev} || {last}, {prev} FROM cut_stems WHERE {last} <> {prev} AND NOT {v(last)} AND NOT {v(prev)}
  UNION ALL SELECT lang, word, stem, known, {head} || v, {last}, v FROM cut_stems CROSS JOIN {vowel} q WHERE {v(last)} AND v <> {last})"""


@plan("A23 A24 J02 N26 F17 K21 K26 W05", stored=True)
def alternation_rules(d: Dialect) -> str:
    """How stems change before suffixes: for stems that are no word any edit that gives one counts, for others doubling and
    clusters; pairs with five words or more; doubled consonants are one rule; the best 60 and ties."""
    structural = "length(surface) = 2 AND length(lexical) = 1 AND left(surface, 1) = lexical"
    return f"""WITH {d.words}, {stems(d, 1, 7)}, {edits(d)},
evidence AS (SELECT e.lang, e.surface, e.lexical, count(*) AS n FROM edits e {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON e.lang = w.lang AND e.restored = w.word WHERE length(e.restored) >= 2 AND (NOT known OR ({structural})) GROUP BY e.lang, e.surface, e.lexical HAVING count(*) >= 5),
rules AS (SELECT lang, CASE WHEN length(surface) = 2 AND left(surface, 1) = right(surface, 1) AND lexical = left(surface, 1) THEN '(C)\\1' ELSE surface || '$' END AS pattern, CASE WHEN length(surface) = 2 AND left(surface, 1) = right(surface, 1) AND lexical = left(surface, 1) THEN '\\1' ELSE lexical END AS restoration, n FROM evidence),
scored AS (SELECT lang, pattern, {d.names('restoration')} AS restorations, {d.total('n')} AS score FROM rules GROUP BY lang, pattern)
SELECT lang, pattern, restorations, score, place FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score DESC) AS place FROM scored) x WHERE place <= 60""".replace("\\1", "\\\\1" if d.spark else "\\1")


@plan("N25 N27 N28 N30 K18 K27 K28", stored=True)
def restored_stems(d: Dialect) -> str:
    """Stems that are no word, each with the restored word of the smallest edit that is one."""
    return f"""WITH {d.words}, {stems(d, 1, 7)}, {edits(d)}
SELECT lang, stem, restored FROM (SELECT lang, stem, restored, row_number() OVER (PARTITION BY lang, stem ORDER BY length(restored) DESC, restored) AS place FROM (SELECT DISTINCT e.lang, e.stem, e.restored FROM edits e {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON e.lang = w.lang AND e.restored = w.word WHERE NOT e.known) y) x WHERE place = 1"""


@plan("N21 N22 N23 N24")
def rule_tiers(d: Dialect) -> str:
    """A restoration's tier: a vowel put back after a consonant, y for i or i for y, and doubling are high, two consonants for
    one are medium, all others low."""
    single = f"length(surface) = 1 AND NOT {v('surface')} AND length(lexical) = 2 AND left(lexical, 1) = surface AND {v('right(lexical, 1)')}"
    double = f"length(surface) = 2 AND length(lexical) = 1 AND NOT {v('left(surface, 1)')} AND NOT {v('right(surface, 1)')} AND NOT {v('lexical')}"
    return f"""WITH {d.words}, {stems(d, 1, 7)}, {edits(d)}, pairs AS (SELECT DISTINCT lang, surface, lexical FROM edits)
SELECT lang, surface, lexical, CASE WHEN ({single}) OR (surface || lexical) IN ('iy', 'yi') OR (length(surface) = 2 AND left(surface, 1) = right(surface, 1) AND lexical = left(surface, 1)) THEN 'high' WHEN {double} THEN 'medium' ELSE 'low' END AS tier FROM pairs"""


@plan("N20", stored=True)
def stem_scores(d: Dialect) -> str:
    """ln(max(2, f)) * (1 + (length - 3) / 4) * (1 + 1.5 * max(0, cover - 0.4)) of the words' kept prefixes."""
    # Spark takes the beginnings of the words, several rows a word, for as small as the words' file, and would broadcast them.
    merge = d.of("/*+ MERGE(k, w) */ ", "")
    return f"""WITH {d.words}, {kept(d)}, covers AS (SELECT {merge}k.lang, k.affix, k.freq, avg(length(k.affix) / CAST(length(w.word) AS DOUBLE)) AS cover FROM kept k JOIN (SELECT lang, word, left(word, n) AS part FROM words {d.count('1', 'least(length(word) - 1, 10)', 'n')}) w ON k.lang = w.lang AND k.affix = w.part WHERE k.side = 'prefix' GROUP BY k.lang, k.affix, k.freq)
SELECT lang, affix, freq, round(ln(greatest(2, freq)) * (1 + (length(affix) - 3) * 0.25) * (1 + greatest(0.0, cover - 0.4) * 1.5) * 1.05, 4) AS score FROM covers"""


@plan("N31", stored=True)
def word_roles(d: Dialect) -> str:
    """Each word's first cut by its longest kept prefix: what the rest is."""
    return f"""WITH {d.words}, {kept(d)}, cuts AS (SELECT c.lang, c.word, max(length(k.affix)) AS n FROM (SELECT lang, word, left(word, n) AS part FROM words {d.count('2', 'length(word) - 2', 'n')}) c JOIN kept k ON k.side = 'prefix' AND c.lang = k.lang AND c.part = k.affix GROUP BY c.lang, c.word),
rests AS (SELECT lang, word, left(word, CAST(n AS INT)) AS prefix, right(word, length(word) - CAST(n AS INT)) AS rest FROM cuts)
SELECT r.lang, CASE WHEN w.word IS NOT NULL THEN 'root' WHEN s.affix IS NOT NULL THEN 'suffix' WHEN length(r.rest) <= 2 THEN 'fragment' ELSE 'unknown' END AS role, count(*) AS n, count(DISTINCT r.prefix) AS n_prefixes
FROM rests r LEFT JOIN words w ON r.lang = w.lang AND r.rest = w.word LEFT JOIN kept s ON s.side = 'suffix' AND r.lang = s.lang AND r.rest = s.affix GROUP BY 1, 2"""


@plan("N32 N33 K20")
def combining_forms(d: Dialect) -> str:
    """Frequent beginnings of four letters or more, with and without a linking o or i, both forms frequent."""
    return f"""WITH {d.words}, {affixes(d, 10, False)}, b AS (SELECT lang, affix, freq FROM affixes WHERE side = 'prefix' AND freq >= 12 AND length(affix) >= 4)
SELECT x.lang, x.affix AS form, y.affix AS linked, x.freq, y.freq AS linked_freq FROM b x JOIN b y ON x.lang = y.lang AND y.affix IN (x.affix || 'o', x.affix || 'i')""".replace("y.affix IN (x.affix || 'o', x.affix || 'i')", "left(y.affix, length(y.affix) - 1) = x.affix AND right(y.affix, 1) IN ('o', 'i')")

"""Affix statistics, selection and typology of a corpus, by language.

Words come from documents.text: lower-cased runs of letters. Prefixes and suffixes are equi-join keys made from each word, so
no plan compares words pair by pair. Counts are aggregated before and after the shuffle by Spark's partial aggregates.
"""

from lexforge.plans.dialect import Dialect, plan

#: Fixed values of the method: thresholds of affix filtering.
FREQUENCY, FREQUENCY_TWO, ASSIMILATED, ASSIMILATED_MOST = 0.035, 0.10, 0.015, 0.12
FRAGMENT = {2: 0.035, 3: 0.08, 4: 0.315}
FRAGMENT_LONG = 0.55
VOWELS = "aeiouy"


def affixes(d: Dialect, longest: int = 10, whole: bool = True) -> str:
    """CTE affixes(lang, side, affix, freq): words that begin or end with each string of 1 to longest letters, and with
    whole the word itself on both sides."""
    top = f"least(length(word), {longest})" if whole else f"least(length(word) - 1, {longest})"
    sql = f"""SELECT lang, side, affix, count(*) AS freq FROM (
  SELECT lang, 'prefix' AS side, left(word, n) AS affix FROM words {d.count('1', top, 'n')}
  UNION ALL SELECT lang, 'suffix' AS side, right(word, n) AS affix FROM words {d.count('1', top, 'n')}) x GROUP BY lang, side, affix"""
    return d.table(f"stored_affixes_{longest}_{int(whole)}", "affixes", sql, d.words)


def edges(d: Dialect, longest: int = 10) -> str:
    """CTE edges(lang, side, parent, child, parent_freq, freq): an affix and those one letter longer."""
    sql = """SELECT c.lang, c.side, p.affix AS parent, c.affix AS child, p.freq AS parent_freq, c.freq
  FROM (SELECT *, CASE WHEN side = 'prefix' THEN left(affix, length(affix) - 1) ELSE right(affix, length(affix) - 1) END AS stem FROM affixes WHERE length(affix) > 1) c
  JOIN affixes p ON c.lang = p.lang AND c.side = p.side AND c.stem = p.affix WHERE c.freq >= greatest(3, 0.01 * p.freq)"""
    return d.table(f"stored_edges_{longest}", "edges", sql, f"{d.words}, {affixes(d, longest)}" if d.stored is not None else "")


def stems(d: Dialect, least: int = 2, longest: int = 8) -> str:
    """CTE derived(lang, side, affix, word): words that leave a word of two letters or more when the affix is taken off."""
    cuts = f"""cuts AS (SELECT lang, 'suffix' AS side, right(word, n) AS affix, word, left(word, length(word) - n) AS stem FROM words {d.count(str(least), f'least(length(word) - 2, {longest})', 'n')}
  UNION ALL SELECT lang, 'prefix' AS side, left(word, n) AS affix, word, right(word, length(word) - n) AS stem FROM words {d.count(str(least), f'least(length(word) - 2, {longest})', 'n')})"""
    derived = f"SELECT c.lang, c.side, c.affix, c.word FROM cuts c {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON c.lang = w.lang AND c.stem = w.word"
    return f"{cuts}, {d.table(f'stored_derived_{least}_{longest}', 'derived', derived, f'{d.words}, {cuts}')}"


@plan("S31 S32 A-corpus T-words")
def word_frequencies(d: Dialect) -> str:
    return f"WITH {d.words} SELECT lang, word, freq FROM corpus"


@plan("A01 J12c")
def affix_frequencies(d: Dialect) -> str:
    return f"WITH {d.words}, {affixes(d)} SELECT lang, side, affix, freq FROM affixes"


@plan("A05")
def affix_frequencies_long(d: Dialect) -> str:
    return f"WITH {d.words}, {affixes(d, 15, False)} SELECT lang, side, affix, freq FROM (SELECT * FROM affixes UNION ALL SELECT lang, 'word', word, 1 FROM words) x WHERE freq > 2"


@plan("A02 U05")
def morpheme_frequencies(d: Dialect) -> str:
    """Inner substrings, prefixes and suffixes, and words of up to ten letters, each counted where it stands."""
    return f"""WITH {d.words}, {affixes(d, 10, False)}, inner_parts AS (SELECT lang, substr(word, i + 1, n) AS part, count(*) AS freq FROM words {d.count('1', 'least(length(word) - 1, 10)', 'n')} {d.count('1', 'length(word) - n - 1', 'i')} GROUP BY lang, substr(word, i + 1, n))
SELECT lang, part, {d.total('freq')} AS freq FROM (SELECT lang, affix AS part, freq FROM affixes UNION ALL SELECT lang, part, freq FROM inner_parts UNION ALL SELECT lang, word, 1 FROM words WHERE length(word) <= 10) x
GROUP BY lang, part HAVING sum(freq) >= 4"""


@plan("A03 A04")
def morpheme_frequencies_without_compounds(d: Dialect) -> str:
    """Affixes of up to 20 letters of words that aren't two words of 40 to 60 % of their length."""
    return f"""WITH {d.words}, halves AS (SELECT lang, word, left(word, n) AS a, right(word, length(word) - n) AS b FROM words {d.count('CAST(ceil(length(word) * 0.4) AS INT)', 'CAST(floor(length(word) * 0.6) AS INT)', 'n')} WHERE length(word) > 6),
compounds AS (SELECT DISTINCT h.lang, h.word FROM halves h JOIN words x ON h.lang = x.lang AND h.a = x.word JOIN words y ON h.lang = y.lang AND h.b = y.word),
single AS (SELECT w.lang, w.word FROM words w {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} compounds c ON w.lang = c.lang AND w.word = c.word)
SELECT lang, side, affix, count(*) AS freq FROM (SELECT lang, 'prefix' AS side, left(word, n) AS affix FROM single {d.count('1', 'least(length(word) - 1, 20)', 'n')}
  UNION ALL SELECT lang, 'suffix', right(word, n) FROM single {d.count('1', 'least(length(word) - 1, 20)', 'n')}) x GROUP BY lang, side, affix HAVING count(*) >= 3"""


@plan("A06")
def prefix_word_counts(d: Dialect) -> str:
    return f"WITH {d.words} SELECT lang, left(word, n) AS prefix, count(*) AS n_words FROM words {d.count('2', 'length(word)', 'n')} GROUP BY lang, left(word, n)"


@plan("A07", stored=True)
def language_bias(d: Dialect) -> str:
    """Suffixing or prefixing: productivity and derived words of both sides, their ratios' geometric mean, and its class."""
    side = lambda s, p: f"coalesce(sum(CASE WHEN side = '{s}' THEN freq * length(affix) END), 0) AS {p}_productivity, count(CASE WHEN side = '{s}' THEN 1 END) AS {p}_candidates"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN NULL ELSE 1.0 END ELSE CAST({a} AS DOUBLE) / {b} END"
    return f"""WITH {d.words}, {stems(d)}, types AS (SELECT lang, side, affix, count(*) AS freq FROM derived GROUP BY lang, side, affix HAVING count(*) >= 5),
sides AS (SELECT lang, {side('suffix', 'suffix')}, {side('prefix', 'prefix')} FROM types GROUP BY lang),
derivations AS (SELECT lang, count(DISTINCT CASE WHEN side = 'suffix' THEN word END) AS suffix_words, count(DISTINCT CASE WHEN side = 'prefix' THEN word END) AS prefix_words FROM derived GROUP BY lang),
counts AS (SELECT lang, count(*) AS n_words FROM words GROUP BY lang),
joined AS (SELECT c.lang, n_words, coalesce(suffix_productivity, 0) AS suffix_productivity, coalesce(prefix_productivity, 0) AS prefix_productivity, coalesce(suffix_candidates, 0) AS suffix_candidates,
  coalesce(prefix_candidates, 0) AS prefix_candidates, coalesce(suffix_words, 0) AS suffix_words, coalesce(prefix_words, 0) AS prefix_words FROM counts c LEFT JOIN sides s ON c.lang = s.lang LEFT JOIN derivations r ON c.lang = r.lang),
ratios AS (SELECT *, {ratio('suffix_productivity', 'prefix_productivity')} AS p, {ratio('suffix_words', 'prefix_words')} AS w FROM joined),
means AS (SELECT *, CASE WHEN n_words < 50 THEN 0.0 WHEN p IS NULL AND w IS NULL THEN 999.0 WHEN p IS NULL THEN w * 2 WHEN w IS NULL THEN p * 2 ELSE sqrt(p * w) END AS mean FROM ratios)
SELECT lang, n_words, CAST(suffix_productivity AS BIGINT) AS suffix_productivity, CAST(prefix_productivity AS BIGINT) AS prefix_productivity, suffix_candidates, prefix_candidates, suffix_words, prefix_words, round(mean, 6) AS ratio,
  CASE WHEN n_words < 50 THEN 'insufficient_data' WHEN mean > 1.4 THEN 'strongly_suffixing' WHEN mean > 1.05 THEN 'weakly_suffixing' WHEN mean < 1 / 1.4 THEN 'strongly_prefixing' WHEN mean < 1 / 1.05 THEN 'weakly_prefixing' ELSE 'neutral' END AS bias,
  round((least(1e0, (suffix_candidates + prefix_candidates) / 30e0) + least(1e0, n_words / 2000e0)) / 2, 6) AS confidence FROM means"""


@plan("A07", stored=True)
def language_bias_by_length(d: Dialect) -> str:
    return f"""WITH {d.words}, {stems(d)}, types AS (SELECT lang, side, affix, count(*) AS freq FROM derived GROUP BY lang, side, affix HAVING count(*) >= 5),
by_length AS (SELECT lang, CAST(length(affix) AS BIGINT) AS n, {d.total("CASE WHEN side = 'suffix' THEN freq * length(affix) ELSE 0 END")} AS suffix_sum, {d.total("CASE WHEN side = 'prefix' THEN freq * length(affix) ELSE 0 END")} AS prefix_sum FROM types GROUP BY lang, length(affix))
SELECT lang, n, suffix_sum, prefix_sum, round(CASE WHEN prefix_sum = 0 THEN 999.0 ELSE suffix_sum / CAST(prefix_sum AS DOUBLE) END, 6) AS ratio FROM by_length"""


@plan("A08")
def mean_stems_by_side(d: Dialect) -> str:
    return f"""WITH {d.words}, {stems(d)}, per_affix AS (SELECT lang, side, affix, count(DISTINCT word) AS n FROM derived GROUP BY lang, side, affix HAVING count(DISTINCT word) >= 5)
SELECT lang, side, count(*) AS n_affixes, round(avg(n), 6) AS mean_stems FROM per_affix GROUP BY lang, side"""


@plan("A09 A10 X6")
def common_affixes(d: Dialect) -> str:
    """Affixes at or above the nearest-rank 90th percentile of their length, and 80 words at least. With one percentile for
    all lengths, as here, the rule for composites of two selected affixes adds none."""
    return f"""WITH {d.words}, {affixes(d, 10, False)}, ranked AS (SELECT *, CAST(length(affix) AS BIGINT) AS n, row_number() OVER (PARTITION BY lang, side, length(affix) ORDER BY freq, affix) AS place, count(*) OVER (PARTITION BY lang, side, length(affix)) AS many FROM affixes),
cuts AS (SELECT lang, side, n, greatest(80, min(CASE WHEN many <= 3 OR place = greatest(1, CAST(ceil(0.9 * many) AS BIGINT)) THEN freq END)) AS least_freq FROM ranked GROUP BY lang, side, n)
SELECT r.lang, r.side, r.affix, r.freq, c.least_freq FROM ranked r JOIN cuts c ON r.lang = c.lang AND r.side = c.side AND r.n = c.n WHERE r.freq >= c.least_freq"""


@plan("J03 J04")
def affix_edges(d: Dialect) -> str:
    return f"WITH {d.words}, {affixes(d)}, {edges(d)} SELECT lang, side, parent, child, parent_freq, freq FROM edges"


@plan("J04")
def affix_relatives(d: Dialect) -> str:
    """How many children, siblings and parents each affix has among the edges."""
    return f"""WITH {d.words}, {affixes(d)}, {edges(d)}, families AS (SELECT lang, side, parent, count(*) AS n FROM edges GROUP BY lang, side, parent)
SELECT e.lang, e.side, e.child AS affix, f.n - 1 AS siblings, coalesce(c.n, 0) AS children FROM edges e JOIN families f ON e.lang = f.lang AND e.side = f.side AND e.parent = f.parent LEFT JOIN families c ON e.lang = c.lang AND e.side = c.side AND e.child = c.parent"""


@plan("A11 A12 A13 A17 X6")
def affix_entropy(d: Dialect) -> str:
    """Shannon entropy of an affix's continuations, and its variation of information with the mass left unexplained."""
    return f"""WITH {d.words}, {affixes(d)}, {edges(d)}, shares AS (SELECT lang, side, parent, parent_freq, sum(freq) OVER (PARTITION BY lang, side, parent) AS known, CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY lang, side, parent) AS p, freq FROM edges),
sums AS (SELECT lang, side, parent AS affix, count(*) AS n, -sum(p * log2(p)) AS h, max(greatest(0.0, 1 - CAST(known AS DOUBLE) / parent_freq)) AS u FROM shares GROUP BY lang, side, parent)
SELECT lang, side, affix, n, round(h, 6) + 0.0 AS entropy, round(h + CASE WHEN u > 0 THEN -u * log2(u) ELSE 0 END, 6) + 0.0 AS variation FROM sums"""


@plan("A14")
def doublet_scores(d: Dialect) -> str:
    """Two-letter affixes: how often the consonant at the boundary is doubled."""
    return f"""WITH {d.words}, {affixes(d)}, two AS (SELECT *, CASE WHEN side = 'prefix' THEN affix || right(affix, 1) ELSE left(affix, 1) || affix END AS doubled FROM affixes WHERE length(affix) = 2)
SELECT t.lang, t.side, t.affix, t.freq, coalesce(x.freq, 0) AS doubled_freq, round(coalesce(x.freq, 0) / CAST(t.freq AS DOUBLE), 6) AS score FROM two t LEFT JOIN affixes x ON t.lang = x.lang AND t.side = x.side AND t.doubled = x.affix"""


@plan("A15")
def affix_log_likelihood(d: Dialect) -> str:
    """2 * O * ln(O / E) of a child against its letter's share among all words' first (or last) letters."""
    return f"""WITH {d.words}, {affixes(d)}, {edges(d)}, letters AS (SELECT lang, side, affix AS letter, freq / CAST(sum(freq) OVER (PARTITION BY lang, side) AS DOUBLE) AS share FROM affixes WHERE length(affix) = 1)
SELECT e.lang, e.side, e.child AS affix, e.freq, round(parent_freq * share, 6) AS expected, round(CASE WHEN parent_freq * share > 0 THEN 2 * e.freq * ln(e.freq / (parent_freq * share)) ELSE 0 END, 4) AS ratio
FROM edges e JOIN letters l ON e.lang = l.lang AND e.side = l.side AND l.letter = CASE WHEN e.side = 'prefix' THEN right(e.child, 1) ELSE left(e.child, 1) END"""


@plan("F11")
def vowel_heavy(d: Dialect) -> str:
    """Consonants to vowels in the first three letters of the 50 most frequent affixes of three letters or more."""
    return f"""WITH {d.words}, {affixes(d)}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, side ORDER BY freq DESC, affix) AS place FROM affixes WHERE length(affix) >= 3) x WHERE place <= 50),
marks AS (SELECT lang, side, CASE WHEN substr(affix, i, 1) IN ({', '.join(f"'{v}'" for v in VOWELS)}) THEN 1 ELSE 0 END AS vowel FROM top {d.count('1', '3', 'i')})
SELECT lang, side, {d.total('vowel')} AS n_vowels, {d.total('1 - vowel')} AS n_consonants, sum(vowel) > 0 AND sum(1 - vowel) <= 3 * sum(vowel) AS heavy FROM marks GROUP BY lang, side"""


def kept(d: Dialect, longest: int = 10) -> str:
    """CTEs up to kept(lang, side, affix, freq): candidates (at least floor(words ** 0.3) words) that pass the filter."""
    vowel = f"'[{VOWELS}]'"
    fragment = "CASE length(a.affix) " + " ".join(f"WHEN {n} THEN {t}" for n, t in FRAGMENT.items()) + f" ELSE {FRAGMENT_LONG} END"
    matches = lambda text, p: f"regexp_like({text}, {p})" if d.spark else f"regexp_matches({text}, {p})"
    return f"""{affixes(d, longest)}, {edges(d, longest)},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, side ORDER BY freq DESC, affix) AS place FROM affixes WHERE length(affix) >= 3) x WHERE place <= 50),
heavy AS (SELECT lang, side, sum(v) > 0 AND sum(1 - v) <= 3 * sum(v) AS heavy FROM (SELECT lang, side, CASE WHEN {matches('substr(affix, i, 1)', vowel)} THEN 1 ELSE 0 END AS v FROM top {d.count('1', '3', 'i')}) x GROUP BY lang, side),
floors AS (SELECT lang, floor(power(count(*), 0.3)) AS least_freq FROM words GROUP BY lang),
a AS (SELECT x.*, coalesce(h.heavy, TRUE) AS heavy, p.freq AS parent_freq, CASE WHEN length(x.affix) = 1 THEN 1.0 ELSE CAST(x.freq AS DOUBLE) / p.freq END AS share FROM (SELECT *, CASE WHEN side = 'prefix' THEN left(affix, length(affix) - 1) ELSE right(affix, length(affix) - 1) END AS stem FROM affixes) x
  JOIN floors f ON x.lang = f.lang LEFT JOIN heavy h ON x.lang = h.lang AND x.side = h.side LEFT JOIN affixes p ON x.lang = p.lang AND x.side = p.side AND x.stem = p.affix WHERE x.freq >= f.least_freq AND (length(x.affix) = 1 OR p.freq IS NOT NULL)),
places AS (SELECT *, row_number() OVER (PARTITION BY lang, side, parent ORDER BY freq DESC, child) AS place, sum(freq) OVER (PARTITION BY lang, side, parent) AS family_freq, count(*) OVER (PARTITION BY lang, side, parent) AS family FROM edges),
parents AS (SELECT DISTINCT lang, side, parent FROM edges),
kids AS (SELECT e.lang, e.side, e.parent, count(*) AS n, max(CASE WHEN place = 1 THEN CAST(e.freq AS DOUBLE) / e.parent_freq END) AS first_share, coalesce(max(CASE WHEN place = 2 THEN CAST(e.freq AS DOUBLE) END) / max(CASE WHEN place = 1 THEN e.freq END), 0.0) AS second_to_first,
  count(CASE WHEN CAST(e.freq AS DOUBLE) / e.parent_freq > {fragment.replace('a.affix', 'e.parent')} THEN 1 END) AS above, count(p.parent) AS deep
  FROM places e LEFT JOIN parents p ON e.lang = p.lang AND e.side = p.side AND e.child = p.parent GROUP BY e.lang, e.side, e.parent),
facts AS (SELECT a.*, coalesce(k.n, 0) AS n_kids, coalesce(k.first_share, 0.0) AS first_share, coalesce(k.second_to_first, 0.0) AS second_to_first, coalesce(k.above, 0) AS above, coalesce(k.deep, 0) AS deep, s.family_freq, s.family, s.in_family, length(a.affix) AS n,
  a.share > 0.70 AS often, (length(a.affix) >= 5 AND a.share > 0.55) OR (length(a.affix) >= 6 AND a.share > 0.25 AND coalesce(k.n, 0) > 0) AS settled, q.affix IS NOT NULL AS parent_in
  FROM a LEFT JOIN kids k ON a.lang = k.lang AND a.side = k.side AND a.affix = k.parent
  LEFT JOIN (SELECT DISTINCT lang, side, parent, family_freq, family, TRUE AS in_family FROM places) s ON a.lang = s.lang AND a.side = s.side AND a.stem = s.parent
  LEFT JOIN a q ON a.lang = q.lang AND a.side = q.side AND a.stem = q.affix),
kept AS (SELECT lang, side, affix, freq FROM facts WHERE
  NOT (n > 1 AND heavy AND NOT {matches('affix', vowel)})
  AND NOT (n >= 3 AND side = 'prefix' AND share <= 0.50 AND {matches('affix', f"'[^{VOWELS}]{{2}}$'")})
  AND share > CASE WHEN n = 2 AND share <= {FREQUENCY_TWO} AND share <= {ASSIMILATED_MOST} AND {matches('affix', f"CASE WHEN side = 'prefix' THEN '^[{VOWELS}][^{VOWELS}]$' ELSE '^[^{VOWELS}][{VOWELS}]$' END")} THEN {ASSIMILATED} WHEN n = 2 THEN {FREQUENCY_TWO} ELSE {FREQUENCY} END
  AND CASE WHEN n = 1 THEN NOT (side = 'suffix' AND affix IN ('a', 'e', 'i', 'o', 'u')) ELSE
    NOT (NOT often AND NOT settled AND above < 2 AND first_share > {FRAGMENT_LONG})
    AND NOT (NOT often AND NOT settled AND above = 1 AND NOT (first_share < {FRAGMENT_LONG} AND share > {FREQUENCY}))
    AND ((second_to_first >= 0.35 AND second_to_first < 0.5) OR often OR (deep >= 3 AND share > 0.10) OR (
      NOT (NOT settled AND n >= 4 AND parent_in AND coalesce(family, 0) >= 3 AND CAST(freq AS DOUBLE) / family_freq < CASE WHEN n_kids = 0 THEN 0.50 ELSE 0.33 END)
      AND NOT (second_to_first >= 0.85 AND first_share > 0.2 AND above < 2))) END)"""


@plan("F06 F06a F06b F06c F06d F06e F06f F07 F08 F10 A33 A34", stored=True)
def filtered_affixes(d: Dialect) -> str:
    """One relational pass: whether a parent is accepted comes down to whether it is a candidate."""
    return f"WITH {d.words}, {kept(d)} SELECT lang, side, affix, freq FROM kept"


@plan("J05 J06 J07 J12d A35 A36 O05 K19", stored=True)
def productive_affixes(d: Dialect) -> str:
    """(free-stem share + 0.05) * log2(frequency with longer candidates + 2) * sqrt(1 + longer candidates), the best 200 a side."""
    cut = lambda side, n, text: f"CASE WHEN {side} = 'prefix' THEN left({text}, {n}) ELSE right({text}, {n}) END"
    return f"""WITH {d.words}, {kept(d)}, chosen AS (SELECT * FROM kept WHERE length(affix) >= 2),
longer AS (SELECT lang, side, {cut('side', 'i', 'affix')} AS affix, count(*) AS n, sum(freq) AS freq FROM chosen {d.count('2', 'length(affix) - 1', 'i')} GROUP BY lang, side, {cut('side', 'i', 'affix')}),
uses AS (SELECT lang, 'prefix' AS side, left(word, i) AS affix, right(word, length(word) - i) AS stem FROM words {d.count('2', 'least(length(word) - 3, 10)', 'i')} UNION ALL SELECT lang, 'suffix', right(word, i), left(word, length(word) - i) FROM words {d.count('2', 'least(length(word) - 3, 10)', 'i')}),
free AS (SELECT u.lang, u.side, u.affix, count(*) AS n, count(w.word) AS hits FROM uses u JOIN chosen c ON u.lang = c.lang AND u.side = c.side AND u.affix = c.affix LEFT JOIN words w ON u.lang = w.lang AND u.stem = w.word GROUP BY u.lang, u.side, u.affix),
scored AS (SELECT c.lang, c.side, c.affix, round((coalesce(CAST(f.hits AS DOUBLE) / f.n, 0) + 0.05) * log2(c.freq + coalesce(l.freq, 0) + 2) * sqrt(1 + coalesce(l.n, 0)), 6) AS score
  FROM chosen c LEFT JOIN longer l ON c.lang = l.lang AND c.side = l.side AND c.affix = l.affix LEFT JOIN free f ON c.lang = f.lang AND c.side = f.side AND c.affix = f.affix)
SELECT lang, side, affix, score, place FROM (SELECT *, row_number() OVER (PARTITION BY lang, side ORDER BY score DESC, affix) AS place FROM scored) x WHERE place <= 200"""


@plan("F12 U04", stored=True)
def affixes_without_duplicates(d: Dialect) -> str:
    """Kept affixes that are no free word, and no free word with one letter more at the boundary."""
    return f"""WITH {d.words}, {kept(d)}, free AS (SELECT lang, word FROM corpus WHERE freq >= 20 AND length(word) >= 2)
SELECT k.lang, k.side, k.affix, k.freq FROM kept k {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} free f ON k.lang = f.lang AND (k.affix = f.word)
WHERE NOT EXISTS (SELECT 1 FROM free g WHERE g.lang = k.lang AND g.word = CASE WHEN k.side = 'prefix' THEN left(k.affix, length(k.affix) - 1) ELSE right(k.affix, length(k.affix) - 1) END)"""


@plan("O06 O07", stored=True)
def affixes_by_length(d: Dialect) -> str:
    return f"WITH {d.words}, {kept(d)} SELECT lang, side, CAST(length(affix) AS BIGINT) AS n, {d.names('affix')} AS affixes FROM kept GROUP BY lang, side, length(affix)"


@plan("J01")
def discovered_suffixes(d: Dialect) -> str:
    return f"""WITH {d.words}, {stems(d, 1, 7)} SELECT lang, affix AS suffix, count(*) AS freq FROM derived WHERE side = 'suffix' GROUP BY lang, affix HAVING count(*) >= 40"""


@plan("A29 A30")
def successor_variety(d: Dialect) -> str:
    """Different letters that follow each beginning of a word, the empty one too."""
    return f"WITH {d.words} SELECT lang, left(word, n) AS beginning, count(DISTINCT substr(word, n + 1, 1)) AS n_next FROM words {d.count('0', 'length(word) - 1', 'n')} GROUP BY lang, left(word, n)"


@plan("A22 U02")
def alphabet(d: Dialect) -> str:
    """The letters of a language, and whether they are known vowels."""
    vowels = ", ".join(f"'{c}'" for c in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ")
    return f"""WITH {d.words} SELECT lang, letter, {d.total('freq')} AS freq, letter IN ({vowels}) AS vowel FROM (SELECT lang, freq, letter FROM corpus {d.each(d.chars('word'), 'letter')}) x GROUP BY lang, letter"""


@plan("W05 O04 A18")
def frequent_words_with_ties(d: Dialect) -> str:
    return f"WITH {d.words} SELECT lang, word, freq, place FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY freq DESC) AS place FROM corpus) x WHERE place <= 100"


@plan("O09")
def covering_words(d: Dialect) -> str:
    """The fewest most frequent words that make up 80 % of a language's tokens."""
    return f"""WITH {d.words}, sums AS (SELECT lang, word, freq, {d.total('freq').replace('AS BIGINT)', 'AS BIGINT)')} AS x FROM corpus GROUP BY lang, word, freq),
running AS (SELECT lang, word, freq, sum(freq) OVER (PARTITION BY lang ORDER BY freq DESC, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(freq) OVER (PARTITION BY lang) AS total FROM sums)
SELECT lang, word, freq FROM running WHERE coalesce(before, 0) < 0.8 * total"""


@plan("O01")
def words_by_length(d: Dialect) -> str:
    return f"WITH {d.words} SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY length(word), word) AS place FROM words"


@plan("F04 F15")
def words_without_both_halves_affixes(d: Dialect) -> str:
    """Words of three letters or more of which no cut leaves a kept prefix before a kept suffix."""
    return f"""WITH {d.words}, {kept(d)}, splits AS (SELECT DISTINCT w.lang, w.word FROM (SELECT lang, word, left(word, n) AS a, right(word, length(word) - n) AS b FROM words {d.count('1', 'length(word) - 1', 'n')}) w
JOIN kept p ON p.side = 'prefix' AND w.lang = p.lang AND w.a = p.affix JOIN kept s ON s.side = 'suffix' AND w.lang = s.lang AND w.b = s.affix)
SELECT w.lang, w.word FROM words w {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} splits s ON w.lang = s.lang AND w.word = s.word WHERE length(w.word) >= 3"""


@plan("J16b")
def redundant_affixes(d: Dialect) -> str:
    return f"""WITH {d.words}, {kept(d)}, parts AS (SELECT lang, affix, left(affix, n) AS part FROM kept {d.count('1', 'length(affix) - 1', 'n')} WHERE side = 'prefix')
SELECT DISTINCT p.lang, p.affix FROM parts p JOIN kept k ON k.side = 'prefix' AND p.lang = k.lang AND p.part = k.affix"""


@plan("J11 J12 J12a J12b J16 J16c J16d K22")
def longest_prefixes_of_words(d: Dialect) -> str:
    """The longest kept prefix of each word, or ''."""
    return f"""WITH {d.words}, {kept(d)}, found AS (SELECT c.lang, c.word, max(length(k.affix)) AS n, count(*) AS matches FROM (SELECT lang, word, left(word, n) AS part FROM words {d.count('1', 'length(word) - 1', 'n')}) c JOIN kept k ON k.side = 'prefix' AND c.lang = k.lang AND c.part = k.affix GROUP BY c.lang, c.word)
SELECT w.lang, w.word, left(w.word, coalesce(CAST(f.n AS INT), 0)) AS prefix, coalesce(f.matches, 0) AS matches FROM words w LEFT JOIN found f ON w.lang = f.lang AND w.word = f.word"""


@plan("J16a")
def next_longer_prefix(d: Dialect) -> str:
    """For each kept prefix, the shortest kept one that is longer by two letters or more."""
    return f"""WITH {d.words}, {kept(d)}, parts AS (SELECT lang, affix AS longer, left(affix, n) AS part FROM kept {d.count('1', 'length(affix) - 2', 'n')} WHERE side = 'prefix')
SELECT lang, affix, longer FROM (SELECT k.lang, k.affix, p.longer, row_number() OVER (PARTITION BY k.lang, k.affix ORDER BY length(p.longer), p.longer) AS place FROM kept k JOIN parts p ON k.side = 'prefix' AND k.lang = p.lang AND k.affix = p.part) x WHERE place = 1"""

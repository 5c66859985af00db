"""Components of compounds, replaced endings, roots by several patterns, and words within words."""

from lexforge.operators import roots
from lexforge.operators.affixes import affixes, kept
from lexforge.plans.dialect import Dialect, plan

#: Endings and what stands for them, the empty one too.
ENDINGS = (("tion", "t"), ("ation", "ate"), ("ung", ""), ("ungen", "ung"), ("ment", ""), ("ción", "r"), ("es", "e"), ("s", ""), ("ly", ""))


def replaced(d: Dialect, source: str, column: str, rules: str, whole: bool = True) -> str:
    """SELECT of source's rows with replaced: the longest ending that a rule names, exchanged; unless whole, empty ones don't count."""
    some = "" if whole else " AND r.put <> ''"
    return f"""SELECT lang, {column}, max_put AS replaced FROM (SELECT x.lang, x.{column}, left(x.{column}, length(x.{column}) - length(r.cut)) || r.put AS max_put, row_number() OVER (PARTITION BY x.lang, x.{column} ORDER BY length(r.cut) DESC) AS place
  FROM (SELECT lang, {column}, right({column}, n) AS ending FROM {source} {d.count('1', f'least(length({column}) - 1, 10)', 'n')}) x JOIN {rules} r ON x.ending = r.cut{some}) y WHERE place = 1"""


@plan("J13 J14 J15")
def replaced_endings(d: Dialect) -> str:
    """Words whose longest known ending is exchanged; and the result where empty replacements don't count."""
    rules = d.rows("cut, put", *ENDINGS)
    return f"""WITH {d.words}, every AS ({replaced(d, 'words', 'word', rules)}), nonempty AS ({replaced(d, 'words', 'word', rules, False)})
SELECT w.lang, w.word, coalesce(e.replaced, w.word) AS replaced, coalesce(s.replaced, w.word) AS replaced_unless_empty FROM words w JOIN every e ON w.lang = e.lang AND w.word = e.word LEFT JOIN nonempty s ON w.lang = s.lang AND w.word = s.word"""


@plan("J10", stored=True)
def compound_components(d: Dialect) -> str:
    """Unknown parts of 3 to 12 letters beside a known form on the left, or else on the right, in two forms and beside two different
    ones; a part that a known form only extends by a linking vowel is restored to it, by its longest ending."""
    return f"""WITH {d.words}, {kept(d)}, forms AS (SELECT DISTINCT lang, affix AS form FROM kept WHERE length(affix) >= 3 UNION SELECT lang, word FROM corpus WHERE freq >= 3 AND length(word) BETWEEN 3 AND 20),
splits AS (SELECT lang, form, left(form, n) AS a, right(form, length(form) - n) AS b FROM forms {d.count('3', 'length(form) - 3', 'n')}),
sides AS (SELECT s.lang, s.form, s.a, s.b, x.form IS NOT NULL AS left_known, y.form IS NOT NULL AS right_known FROM splits s LEFT JOIN forms x ON s.lang = x.lang AND s.a = x.form LEFT JOIN forms y ON s.lang = y.lang AND s.b = y.form),
parts AS (SELECT lang, form, CASE WHEN left_known THEN b ELSE a END AS part, CASE WHEN left_known THEN a ELSE b END AS anchor FROM sides WHERE left_known OR right_known),
found AS (SELECT p.lang, p.part, count(*) AS n, count(DISTINCT p.anchor) AS n_anchors FROM parts p {d.of('LEFT ANTI JOIN', 'ANTI JOIN')} forms f ON p.lang = f.lang AND p.part = f.form WHERE length(p.part) BETWEEN 3 AND 12 GROUP BY p.lang, p.part HAVING count(*) >= 2 AND count(DISTINCT p.anchor) >= 2),
longer AS (SELECT f.lang, f.part, max(k.form) AS restored FROM found f JOIN forms k ON f.lang = k.lang AND f.part = left(k.form, length(k.form) - 1) AND right(k.form, 1) IN ('o', 'i', 'e') GROUP BY f.lang, f.part),
endings AS (SELECT lang, part AS cut, restored AS put FROM longer),
matched AS (SELECT x.lang, x.part, left(x.part, length(x.part) - length(e.cut)) || e.put AS restored, row_number() OVER (PARTITION BY x.lang, x.part ORDER BY length(e.cut) DESC) AS place FROM (SELECT lang, part, right(part, k) AS ending FROM found {d.count('3', 'length(part)', 'k')}) x JOIN endings e ON x.lang = e.lang AND x.ending = e.cut)
SELECT f.lang, f.part, f.n, f.n_anchors, coalesce(m.restored, f.part) AS restored FROM found f LEFT JOIN matched m ON f.lang = m.lang AND f.part = m.part AND m.place = 1"""


@plan("A19", stored=True)
def extracted_roots(d: Dialect) -> str:
    """Roots by pattern; where several find one, the first counts: before vowels, before a linker, with the linker taken off (15
    uses and 60 % words), free words."""
    linked = f"SELECT lang, form, n_rests, free_share FROM ({roots.forms_ending_in_a_linker(d)}) x"
    return f"""SELECT lang, root, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY lang, root ORDER BY priority) AS place FROM (
  SELECT lang, root, 'vowel' AS pattern, 1 AS priority, CAST(n AS BIGINT) AS n FROM ({roots.roots_before_vowels(d)}) a UNION ALL SELECT lang, form, 'linker', 2, CAST(n_rests AS BIGINT) FROM ({linked}) b
  UNION ALL SELECT lang, left(form, length(form) - 1), 'stripped', 3, CAST(max(n_rests) AS BIGINT) FROM ({linked}) c WHERE n_rests >= 15 AND free_share >= 0.6 AND length(form) > 3 GROUP BY lang, left(form, length(form) - 1)
  UNION ALL SELECT lang, word, 'free', 4, freq FROM ({roots.free_roots(d)}) f) u) r WHERE place = 1"""


@plan("N05")
def words_within(d: Dialect) -> str:
    """Words that are one of the most frequent words of three letters with one more letter on one side at most, by a regular expression
    made of them; none of them gives one that never matches."""
    like = lambda p: d.of(f"regexp_like(w.word, {p})", f"regexp_matches(w.word, {p})")
    some = f"(SELECT lang, {d.of("array_join(array_sort(collect_set(word)), '|')", "string_agg(DISTINCT word, '|' ORDER BY word)")} AS parts FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS place FROM corpus WHERE length(word) = 3) x WHERE place <= 20 GROUP BY lang)"
    pattern = "'^(.?(' || coalesce(p.parts, 'a^') || ')|(' || coalesce(p.parts, 'a^') || ').?)$'"
    return f"""WITH {d.words} SELECT w.lang, w.word FROM words w JOIN {some} p ON w.lang = p.lang WHERE {like(pattern)}"""

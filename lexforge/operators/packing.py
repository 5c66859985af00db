"""From token ids to training batches: packing, positions, labels, masks; all by windows over (stream, step, place)."""

from lexforge.plans.dialect import Dialect, plan

#: Ids of the special tokens, and the length of a row and number of streams of the packed batches.
PAD, BOS, EOS, UNK, MAX_LEN, STREAMS = 0, 1, 2, 3, 64, 16


def ids(d: Dialect) -> str:
    """CTEs vocab(token, id) by frequency, ids from 4, and sent(conv_id, turn, place, id): BOS, the turn's tokens, EOS."""
    return f"""said AS (SELECT conv_id, turn, place, token FROM conversations {d.each_at(d.found("lower(text)", r"\p{L}+|[0-9]+|[^\p{L}0-9\s]"), "place", "token")}),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM said GROUP BY token HAVING count(*) >= 2) x),
sent AS (SELECT s.conv_id, s.turn, CAST(s.place + 1 AS BIGINT) AS place, coalesce(v.id, {UNK}) AS id FROM said s LEFT JOIN vocab v ON s.token = v.token
  UNION ALL SELECT conv_id, turn, 0, {BOS} FROM conversations UNION ALL SELECT conv_id, turn, 1000000000, {EOS} FROM conversations)"""


def packed(d: Dialect) -> str:
    """CTE packed(stream, step, place, id): all tokens in order, laid out over the streams and padded at the end.
    The running place is a sum over turns, each turn numbered by itself, so no window holds all tokens."""
    return f"""{ids(d)}, lengths AS (SELECT conv_id, turn, count(*) AS n FROM sent GROUP BY conv_id, turn),
starts AS (SELECT conv_id, turn, coalesce(sum(n) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lengths),
numbered AS (SELECT t.id, CAST(s.start + row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY t.place) - 1 AS BIGINT) AS spot FROM sent t JOIN starts s ON t.conv_id = s.conv_id AND t.turn = s.turn),
shape AS (SELECT CAST(ceil(ceil(count(*) / CAST({STREAMS} AS DOUBLE)) / {MAX_LEN}) * {MAX_LEN} AS BIGINT) AS per_stream, count(*) AS n FROM sent),
slots AS (SELECT CAST(id AS BIGINT) AS id, spot, per_stream FROM numbered CROSS JOIN shape UNION ALL SELECT {PAD}, CAST(spot AS BIGINT), per_stream FROM shape {d.count('n', f'per_stream * {STREAMS} - 1', 'spot')}),
packed AS (SELECT CAST({d.of('spot DIV per_stream', 'spot // per_stream')} AS BIGINT) AS stream, CAST({d.of(f'(spot % per_stream) DIV {MAX_LEN}', f'(spot % per_stream) // {MAX_LEN}')} AS BIGINT) AS step, CAST(spot % per_stream % {MAX_LEN} AS BIGINT) AS place, id FROM slots)"""


@plan("N38 K08 K10 K11 W07")
def vocabulary(d: Dialect) -> str:
    """Tokens of two occurrences or more by dense id, after the special ones, and their pseudo-frequency by rank."""
    return f"WITH {ids(d)} SELECT token, id, (SELECT count(*) FROM vocab) * 5 - 5 * (id - 4) AS pseudo_freq FROM vocab"


@plan("K02 K24 K01")
def encoded_turns(d: Dialect) -> str:
    text = "array_join(transform(array_sort(collect_list(struct(place, id))), x -> CAST(x.id AS STRING)), ' ')" if d.spark else "string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place)"
    return f"WITH {ids(d)} SELECT conv_id, turn, count(*) AS n, {text} AS ids FROM sent GROUP BY conv_id, turn"


@plan("K03 K25")
def decoded_turns(d: Dialect) -> str:
    """Ids back to tokens, control ids dropped."""
    text = "array_join(transform(array_sort(collect_list(struct(place, token))), x -> x.token), ' ')" if d.spark else "string_agg(token, ' ' ORDER BY place)"
    return f"WITH {ids(d)} SELECT conv_id, turn, {text} AS text FROM (SELECT s.conv_id, s.turn, s.place, coalesce(v.token, '?') AS token FROM sent s LEFT JOIN vocab v ON s.id = v.id WHERE s.id >= {UNK}) x GROUP BY conv_id, turn"


@plan("C01 C02")
def padded_turns(d: Dialect) -> str:
    """Cut to 32 ids or padded on the right; and the reversed row padded on the left."""
    row = lambda by, some: d.of(f"array_join(transform(array_sort(collect_list(CASE WHEN {some} THEN struct({by}, id) END)), x -> CAST(x.id AS STRING)), ' ')", f"string_agg(CASE WHEN {some} THEN CAST(id AS VARCHAR) END, ' ' ORDER BY {by})")
    return f"""WITH {ids(d)}, rows_ AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) AS nth, count(*) OVER (PARTITION BY conv_id, turn) AS n, id FROM sent)
SELECT conv_id, turn, min(n) AS n, least(32, min(n)) AS n_kept, greatest(0, 32 - min(n)) AS n_pad, {d.total('CASE WHEN nth <= 32 THEN id * nth ELSE 0 END')} AS checksum, {d.total('CASE WHEN nth <= 32 THEN id * (33 - nth) ELSE 0 END')} AS reverse_checksum,
  {row('nth', 'nth <= 32')} || repeat(' {PAD}', CAST(greatest(0, 32 - min(n)) AS INT)) AS padded, repeat('{PAD} ', CAST(greatest(0, 32 - min(n)) AS INT)) || {row('-nth', 'nth <= 32')} AS reversed_padded FROM rows_ GROUP BY conv_id, turn"""


@plan("T02 S03")
def packed_batches(d: Dialect) -> str:
    return f"WITH {packed(d)} SELECT stream, step, place, id FROM packed"


def marked(d: Dialect) -> str:
    """CTE marked: packed with sub_sequence, position, label, is_continuation and is_first."""
    row = "PARTITION BY stream, step ORDER BY place"
    return f"""{packed(d)}, sums AS (SELECT *, sum(CASE WHEN id = {BOS} THEN 1 ELSE 0 END) OVER ({row} ROWS UNBOUNDED PRECEDING) AS resets, sum(CASE WHEN id <> {PAD} THEN 1 ELSE 0 END) OVER ({row} ROWS UNBOUNDED PRECEDING) AS seen,
  first_value(id) OVER ({row} ROWS UNBOUNDED PRECEDING) AS first_id, lead(id) OVER ({row}) AS next_id FROM packed),
bases AS (SELECT *, max(CASE WHEN id = {BOS} OR place = 0 THEN seen - CASE WHEN id <> {PAD} THEN 1 ELSE 0 END ELSE 0 END) OVER ({row} ROWS UNBOUNDED PRECEDING) AS base FROM sums),
lengths_before AS (SELECT stream, step, max(CASE WHEN resets_at_end = resets THEN seen - base END) AS tail FROM (SELECT *, max(resets) OVER (PARTITION BY stream, step) AS resets_at_end FROM bases) x GROUP BY stream, step),
marked AS (SELECT b.stream, b.step, b.place, b.id, CASE WHEN b.id = {PAD} THEN 0 ELSE b.resets + b.stream * ({MAX_LEN} + 1) END AS sub_sequence, CASE WHEN b.id = {PAD} THEN 0 ELSE b.seen - b.base - 1 END AS position,
  CASE WHEN b.id = {PAD} THEN -100 ELSE coalesce(b.next_id, -100) END AS label, b.first_id NOT IN ({BOS}, {PAD}) AND b.resets = 0 AS is_continuation FROM bases b)"""


@plan("W01 W02 W03 T11")
def sequence_marks(d: Dialect) -> str:
    """Sub-sequence, position within it, next-token label and continuation of every packed token."""
    return f"WITH {marked(d)} SELECT stream, step, place, id, CAST(sub_sequence AS BIGINT) AS sub_sequence, CAST(position AS BIGINT) AS position, CAST(label AS BIGINT) AS label, is_continuation FROM marked"


@plan("W04")
def sequence_starts(d: Dialect) -> str:
    return f"""WITH {marked(d)} SELECT stream, step, count(*) AS n_starts FROM (SELECT stream, step, sub_sequence, lag(sub_sequence) OVER (PARTITION BY stream, step ORDER BY place) AS before FROM marked) x WHERE before IS NULL OR before <> sub_sequence GROUP BY stream, step"""


@plan("W03")
def attention_sizes(d: Dialect) -> str:
    """Keys that each query token may look at: those of its sub-sequence up to itself; counted by a window, not by pairs."""
    return f"""WITH {marked(d)} SELECT stream, step, {d.total('keys')} AS n_allowed, count(*) AS n_tokens FROM (SELECT stream, step, count(*) OVER (PARTITION BY stream, step, sub_sequence ORDER BY place ROWS UNBOUNDED PRECEDING) AS keys FROM marked WHERE sub_sequence > 0) x GROUP BY stream, step"""


@plan("T01")
def past_lengths(d: Dialect) -> str:
    """Tokens since the last reset at the start of each step of a stream, over all steps before it."""
    return f"""WITH {packed(d)}, runs AS (SELECT *, sum(CASE WHEN id = {BOS} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY step, place ROWS UNBOUNDED PRECEDING) AS run FROM packed),
counts AS (SELECT *, sum(CASE WHEN id <> {PAD} THEN 1 ELSE 0 END) OVER (PARTITION BY stream, run ORDER BY step, place ROWS UNBOUNDED PRECEDING) AS n FROM runs)
SELECT stream, step + 1 AS step, CAST(n AS BIGINT) AS past_length FROM counts WHERE place = {MAX_LEN} - 1"""


@plan("C03 C06")
def prompt_target_pairs(d: Dialect) -> str:
    """A turn and the next one as prompt and target: the prompt's labels are -100."""
    return f"""WITH {ids(d)}, turns AS (SELECT conv_id, turn, count(*) AS n, {d.total('id')} AS s FROM sent GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, a.n AS n_masked, b.n - 1 AS n_target, a.n + b.n - 1 AS n, -100 * a.n + b.s - {BOS} AS label_sum FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


@plan("A25 K23")
def tokenizer_report(d: Dialect) -> str:
    """Tokens a turn, share outside the vocabulary, used part of the vocabulary."""
    return f"""WITH {ids(d)} SELECT count(*) AS n_tokens, count(DISTINCT id) AS n_used, round(avg(CASE WHEN id = {UNK} THEN 1e0 ELSE 0e0 END), 6) AS oov, round(count(*) / CAST(count(DISTINCT {d.of('struct(conv_id, turn)', '(conv_id, turn)')}) AS DOUBLE), 6) AS per_turn, round(count(DISTINCT id) / CAST((SELECT count(*) FROM vocab) AS DOUBLE), 6) AS utilisation FROM sent WHERE id >= {UNK}"""


@plan("W06 A27 V09")
def pair_affinities(d: Dialect) -> str:
    """Adjacent tokens: how often, and the mean, extremes and deviation over a token's successors."""
    return f"""WITH {ids(d)}, pairs AS (SELECT id AS a, lead(id) OVER (PARTITION BY conv_id, turn ORDER BY place) AS b FROM sent), counts AS (SELECT a, b, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY a, b)
SELECT a, count(*) AS n_next, {d.total('n')} AS total, min(n) AS least_n, max(n) AS most_n, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS deviation FROM counts GROUP BY a"""


@plan("K05")
def token_graph_edges(d: Dialect) -> str:
    """Substrings of conversation words (15 letters at most) that are vocabulary tokens: a word's number of edges."""
    return f"""WITH {ids(d)}, w AS (SELECT DISTINCT token AS word FROM said), cuts AS (SELECT word, i, n, substr(word, i, n) AS part FROM w {d.count('1', 'length(word)', 'i')} {d.count('1', 'least(15, length(word) - i + 1)', 'n')})
SELECT c.word, count(*) AS n_edges, count(DISTINCT c.i) AS n_starts, max(CAST(c.n AS BIGINT)) AS longest FROM cuts c JOIN vocab v ON c.part = v.token GROUP BY c.word"""


@plan("W08 W09")
def joined_spaces(d: Dialect) -> str:
    """Single spaces between two words are dropped from a turn's tokens and are put back by the words around."""
    return f"""WITH parts AS (SELECT conv_id, turn, place, token FROM conversations {d.each_at(d.found("text", r"\s{2,}|\p{L}+|\s|[^\p{L}\s]"), "place", "token")}),
around AS (SELECT *, lag(token) OVER (PARTITION BY conv_id, turn ORDER BY place) AS before, lead(token) OVER (PARTITION BY conv_id, turn ORDER BY place) AS after FROM parts),
flags AS (SELECT *, token = ' ' AND {d.of('regexp_like', 'regexp_matches')}(coalesce(before, ''), {d.re('^\\p{L}')}) AND {d.of('regexp_like', 'regexp_matches')}(coalesce(after, ''), {d.re('^\\p{L}')}) AS gone FROM around)
SELECT conv_id, turn, count(*) AS n, count(CASE WHEN gone THEN 1 END) AS n_dropped, count(CASE WHEN NOT gone THEN 1 END) AS n_left FROM flags GROUP BY conv_id, turn"""


@plan("C08")
def class_weights(d: Dialect) -> str:
    """Inverse class frequencies, normalised to a mean of 1."""
    return "WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic), w AS (SELECT *, 1e0 / n AS inverse FROM c) SELECT quality, toxic, n, round(inverse / avg(inverse) OVER (), 6) AS weight FROM w"

"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

from . import fingerprints, licences, mixing, phrases, sharding, warc

#: crc32 of UTF-8 bytes: the table by its rule, then one step per byte.
CRC_TABLE = """
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_steps
)"""


def crc32(text: str) -> str:
    """crc32 of a text expression; ``crc_steps`` must be in scope."""
    digits = "'0123456789ABCDEF'"
    byte = f"lambda h: (instr({digits}, h[1]) - 1) * 16 + instr({digits}, h[2]) - 1"
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), {byte})"
    step = "lambda c, b: xor(c // 256, crc_steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {values}), {step}), 4294967295)"


def slot_of(digest: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {n} AS INTEGER)"


def op1_sharding() -> str:
    slots, keep = sharding.N_SLOTS, sharding.N_SLOTS // 17 + 1  # 4096 = 17 * 240 + 16: all 16 old shards keep one more
    return f"""WITH {CRC_TABLE},
r AS (
    SELECT doc_id, CAST(octet_length(encode(COALESCE(text, ''))) + 1 AS BIGINT) AS size,
           CAST({crc32("COALESCE(text, '')")} AS BIGINT) AS text_crc32,
           {slot_of("md5(COALESCE(CAST(doc_id AS VARCHAR), ''))", slots)} AS virtual_slot
    FROM documents, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, virtual_slot % 16 AS shard, virtual_slot,
       ROW_NUMBER() OVER (PARTITION BY virtual_slot % 16
                          ORDER BY virtual_slot, text_crc32 % {sharding.RANK_PARTS}, doc_id, text_crc32, size) - 1 AS slot,
       CASE WHEN virtual_slot // 16 < {keep} THEN virtual_slot % 16 ELSE 16 END AS grown_shard
FROM r
"""


def op2_mixing() -> str:
    grid = mixing.GRID
    z = "list_sum(list_transform(shares, lambda p: pow(p, {a})))"
    entropy = "ln(" + z + ") - {a} * list_sum(list_transform(shares, lambda p: pow(p, {a}) * ln(p))) / " + z
    a = f"((low + high) // 2 / CAST({grid} AS DOUBLE))"
    return f"""WITH RECURSIVE
d AS (
    SELECT doc_id, source, COALESCE('+' || source, '-') AS src,
           CAST(len(regexp_extract_all(COALESCE(text, ''), '{mixing.WORD}')) AS BIGINT) AS n_tokens,
           md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(text, '')) AS digest
    FROM documents
),
b AS (SELECT *, {slot_of('digest', mixing.N_BLOCKS)} AS block FROM d),
sources AS (SELECT src, SUM(n_tokens) AS t FROM b GROUP BY src),
head AS (
    SELECT COUNT(*) AS n, CAST(SUM(t) AS DOUBLE) AS total, MAX(t) AS most, MIN(t) AS least,
           list(t / (SELECT CAST(SUM(t) AS DOUBLE) FROM sources)) AS shares
    FROM sources WHERE t > 0
),
bisect(low, high) AS (
    SELECT -1, {grid}
    UNION ALL
    SELECT CASE WHEN ok THEN low ELSE (low + high) // 2 END, CASE WHEN ok THEN (low + high) // 2 ELSE high END
    FROM (SELECT low, high, {entropy.format(a=a)} <= 0.95 * ln(greatest(n, 2)) AND pow(most / least, 1 - {a}) <= 2.0 AS ok
          FROM bisect, head WHERE high - low > 1)
),
found AS (SELECT high / CAST({grid} AS DOUBLE) AS alpha FROM bisect WHERE high - low = 1),
weighted AS (
    SELECT src, t, alpha, CASE WHEN t > 0 THEN pow(t / total, alpha) / {z.format(a='alpha')} ELSE 0 END AS weight,
           most / (pow(most / total, alpha) / {z.format(a='alpha')}) AS budget
    FROM sources, head, found
),
quotas AS (SELECT *, greatest(CAST(round(budget * weight) AS BIGINT), t) AS quota FROM weighted),
epochs AS (
    SELECT *, CASE WHEN t > 0 THEN CAST(quota // t AS INTEGER) ELSE 1 END AS whole FROM quotas
),
blocks AS (SELECT src, block, SUM(n_tokens) AS block_tokens FROM b GROUP BY src, block),
starts AS (
    SELECT e.*, block, epoch,
           epoch * t + SUM(block_tokens) OVER (PARTITION BY src, epoch ORDER BY md5(concat_ws('|', src, epoch, block)), block)
               - block_tokens AS block_start
    FROM (SELECT *, unnest(range(CASE WHEN quota > whole * t THEN whole + 1 ELSE whole END)) AS epoch FROM epochs) e
    JOIN blocks USING (src)
),
placed AS (
    SELECT b.doc_id, b.source, b.n_tokens, s.*,
           block_start + SUM(b.n_tokens) OVER (PARTITION BY src, epoch, block ORDER BY digest ROWS UNBOUNDED PRECEDING) AS upto
    FROM b JOIN starts s USING (src, block)
)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, alpha, round(weight, 9) AS weight,
       round(CASE WHEN quota > 0 THEN (upto - n_tokens / 2) / quota ELSE 0 END, 9) AS mix_position
FROM placed WHERE epoch < whole OR upto <= quota
"""


def op4_repeats() -> str:
    return """WITH
d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, ROW_NUMBER() OVER () AS rid FROM documents),
starts AS (
    SELECT rid, unnest(range(CAST(len(h) // 2 - 199 AS BIGINT))) AS pos, h FROM d WHERE len(h) >= 400
),
strings AS (SELECT rid, pos, md5(substr(h, 2 * pos + 1, 400)) AS s FROM starts),
repeated AS (SELECT rid, pos FROM strings SEMI JOIN (SELECT s FROM strings GROUP BY s HAVING COUNT(*) > 1) USING (s)),
spans AS (
    SELECT rid, MIN(pos) AS lo, MAX(pos) + 200 AS hi
    FROM (SELECT rid, pos, SUM(fresh) OVER (PARTITION BY rid ORDER BY pos) AS span
          FROM (SELECT rid, pos, CASE WHEN pos - LAG(pos) OVER (PARTITION BY rid ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS fresh FROM repeated))
    GROUP BY rid, span
),
kept AS (
    SELECT rid, COUNT(*) AS n_spans, SUM(hi - lo) AS n_removed,
           list_sort(list_concat([0], list(hi))) AS ends, list_sort(list(lo)) AS begins
    FROM spans GROUP BY rid
),
parts AS (
    SELECT d.*, COALESCE(n_spans, 0) AS n_spans, COALESCE(n_removed, 0) AS n_removed,
           CASE WHEN ends IS NULL THEN h ELSE array_to_string(
               list_transform(range(1, len(ends) + 1), lambda i: substr(h, 2 * ends[i] + 1, 2 * (COALESCE(begins[i], len(h) // 2) - ends[i]))), '') END AS left_over
    FROM d LEFT JOIN kept USING (rid)
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(left_over)) AS kept_sha256
FROM parts
"""


def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace({text}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ')"


def _lower(text: str) -> str:
    return f"translate(COALESCE({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op5_licences() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licences.PHRASES.items())
    templates = ", ".join(f"(list_distinct(string_split('{t}', ' ')), '{label}')" for t, label in licences.TEMPLATES.items())
    size = max(licences.BLOCK_WORDS, *(2 * len(t.split()) for t in licences.TEMPLATES))
    return f"""WITH
d AS (
    SELECT ROW_NUMBER() OVER () AS rid, doc_id, {_lower('text')} AS t,
           list_filter({_words(_lower('text'))}, lambda w: w <> '') AS words
    FROM documents
),
phrases(phrase, label, n) AS (VALUES {phrases}),
templates(template, label) AS (VALUES {templates}),
places AS (
    SELECT rid, label, pos FROM (SELECT rid, words, unnest(range(len(words))) AS pos FROM d WHERE t LIKE '%license%'), phrases
    WHERE array_to_string(words[pos + 1 : pos + n], ' ') = phrase
),
base AS (
    SELECT rid, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY rid
),
places_of_words AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
template_words AS (SELECT template, label, unnest(template) AS word FROM templates),
held AS (
    SELECT rid, label, template, COUNT(DISTINCT word) OVER (
        PARTITION BY rid, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND {size - 1} FOLLOWING
    ) AS n
    FROM places_of_words JOIN template_words USING (word)
),
matches AS (
    SELECT rid, label, n / len(template) AS containment FROM held
    WHERE n >= ceil({licences.THRESHOLD} * len(template) - 1e-9)
),
found AS (SELECT rid, list_distinct(list(label)) AS labels, MAX(containment) AS score FROM matches GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(COALESCE(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(COALESCE(base.labels, []), COALESCE(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base IS NOT NULL THEN 1.0 ELSE COALESCE(score, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""


def op8_fingerprints() -> str:
    prime, base, places, k, window = (getattr(fingerprints, n) for n in ("PRIME", "BASE", "POSITIONS", "K", "WINDOW"))

    def steps(name: str, source: str, text: str, keep: str) -> str:
        """CTEs that end in ``name``: the columns kept, and the selected grams of a text."""
        cols = ", ".join(keep.split())
        words = f"list_filter(regexp_split_to_array({text}, '{fingerprints.BLANKS}'), lambda w: w <> '')"
        return f"""
{name}_w AS (SELECT {cols}, {words} AS w FROM {source}),
{name}_1 AS (
    SELECT {cols}, w, list_transform(w, lambda x: CAST({crc32('x')} AS BIGINT)) AS g1,
           CAST({crc32("array_to_string(w, ' ')")} AS BIGINT) AS whole FROM {name}_w, crc_table
),
{name}_2 AS (
    SELECT *, list_transform(range(1, len(g1)), lambda i: (g1[i] * {base} + g1[i + 1]) % {prime}) AS g2 FROM {name}_1
),
{name}_4 AS (
    SELECT *, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [whole % {prime}]
              ELSE list_transform(range(1, len(g2) - 1), lambda i: (g2[i] * {base * base} + g2[i + 2]) % {prime}) END AS g4 FROM {name}_2
),
{name}_v AS (
    SELECT *, list_transform(range(1, len(g4) + 1), lambda i: g4[i] * {places} + {places - 1} - (i - 1)) AS v FROM {name}_4
),
{name}_m AS (
    SELECT *, CASE WHEN len(v) = 0 THEN [] WHEN len(v) < {window} THEN [list_min(v)]
              ELSE list_transform(range(1, len(v) - {window - 2}), lambda i: list_min(v[i : i + {window - 1}])) END AS m FROM {name}_v
),
{name} AS (
    SELECT {cols}, list_transform(list_filter(range(1, len(m) + 1), lambda i: i = 1 OR m[i] <> m[i - 1]), lambda i: m[i]) AS grams FROM {name}_m
)"""

    def text(grams: str) -> str:
        return f"array_to_string(list_transform({grams}, lambda g: format('{{:x}}', g // {places}) || ':' || CAST({places - 1} - g % {places} AS VARCHAR)), ' ')"

    def likeness(a: str, b: str) -> str:
        one, two = (f"list_distinct(list_transform({x}, lambda g: g // {places}))" for x in (a, b))
        common = f"len(list_intersect({one}, {two}))"
        union = f"(len({one}) + len({two}) - {common})"
        return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {common} / {union}::DOUBLE END"

    return f"""WITH {CRC_TABLE},
d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
{steps('own', 'd', 'text', 'doc_id text')},
pairs AS (
    SELECT doc_id, text, grams, COALESCE(LEAD(text) OVER down, FIRST_VALUE(text) OVER down) AS next_text,
           COALESCE(LEAD(grams) OVER down, FIRST_VALUE(grams) OVER down) AS next_grams
    FROM own WINDOW down AS (ORDER BY doc_id DESC)
),
edits AS (
    SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM pairs
),
{steps('new', 'edits', 'edited', 'doc_id edited')}
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, {text('e.grams')} AS fingerprint,
       {text('n.grams')} AS edited_fingerprint, {likeness('e.grams', 'n.grams')} AS near_edited,
       {likeness('e.grams', 'e.next_grams')} AS near_next
FROM edits e JOIN new n ON e.doc_id = n.doc_id
"""


COMPONENTS = """
reach(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)"""


def op9_vectors() -> str:
    return f"""WITH RECURSIVE
v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y
    WHERE x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95
),{COMPONENTS}
SELECT vec_id, COALESCE(n_links, 0) AS n_links, COALESCE(least(vec_id, first), vec_id) AS component_id,
       COALESCE(vec_id <= first, true) AS kept
FROM embeddings
LEFT JOIN (SELECT a AS vec_id, COUNT(*) AS n_links FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, MIN(b) AS first FROM reach GROUP BY a) USING (vec_id)
"""


def op10_jaccard() -> str:
    return f"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{mixing.WORD}') AS w FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS set_ FROM d
),
tokens AS (SELECT doc_id, len(set_) AS n, unnest(set_) AS token FROM s),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 90 * (x.n + y.n - COUNT(*))
),{COMPONENTS}
SELECT doc_id, CAST(len(set_) AS BIGINT) AS n_shingles, COALESCE(least(doc_id, first), doc_id) AS component_id
FROM s LEFT JOIN (SELECT a AS doc_id, MIN(b) AS first FROM reach GROUP BY a) USING (doc_id)
"""


def op11_phrases() -> str:
    # A candidate's cuts by their score, then by the length of the first part.
    score = f"{phrases.SCALE}::HUGEINT * {{0}}.a::HUGEINT * {{0}}.a::HUGEINT // ({{1}}::HUGEINT * {{2}}::HUGEINT)"
    return f"""WITH
pieces AS (
    SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex({_lower("COALESCE(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f1 AS (SELECT lang, p, COUNT(*) AS n FROM (SELECT lang, unnest(w) AS p FROM w) GROUP BY ALL),
f2 AS (SELECT lang, p, q, COUNT(*) AS a FROM (
    SELECT lang, w[i] AS p, w[i + 1] AS q FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY ALL HAVING COUNT(*) >= {phrases.LEAST_COUNT}),
f3 AS (SELECT lang, p, q, r, COUNT(*) AS a FROM (
    SELECT lang, w[i] AS p, w[i + 1] AS q, w[i + 2] AS r FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w)) GROUP BY ALL HAVING COUNT(*) >= {phrases.LEAST_COUNT}),
longer AS (SELECT lang, p, q, MAX(a) AS a FROM (SELECT lang, p, q, a FROM f3 UNION ALL SELECT lang, q, r, a FROM f3) GROUP BY ALL),
two AS (
    SELECT f2.lang, f2.p || ' ' || f2.q AS phrase, f2.a, x.n AS l, y.n AS r, {score.format("f2", "x.n", "y.n")} AS score
    FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.p = f2.p JOIN f1 y ON y.lang = f2.lang AND y.p = f2.q
    LEFT JOIN longer ON longer.lang = f2.lang AND longer.p = f2.p AND longer.q = f2.q
    WHERE COALESCE(100 * longer.a < 50 * f2.a, TRUE)
),
cuts AS (
    SELECT f3.lang, f3.p || ' ' || f3.q || ' ' || f3.r AS phrase, f3.a, x.n AS l1, yz.a AS r1, xy.a AS l2, z.n AS r2,
           {score.format("f3", "x.n", "yz.a")} AS s1, {score.format("f3", "xy.a", "z.n")} AS s2
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.p = f3.p JOIN f1 z ON z.lang = f3.lang AND z.p = f3.r
    JOIN f2 xy ON xy.lang = f3.lang AND xy.p = f3.p AND xy.q = f3.q JOIN f2 yz ON yz.lang = f3.lang AND yz.p = f3.q AND yz.q = f3.r
),
kept AS (
    SELECT * FROM two UNION ALL
    SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, SUM(n) AS n FROM f1 GROUP BY lang) total USING (lang) WHERE rank <= {phrases.TOP}
"""


def op13_warc() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER) + 1, 1)"
    return f"""WITH
p AS (SELECT page_id, COALESCE(html, '') AS h, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(h) AS s, COALESCE(first IS NOT NULL AND (page_id IS NULL OR page_id <> first), FALSE) AS again FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
       CASE WHEN again THEN '{warc.REVISIT}' ELSE '{warc.RESPONSE}' END AS record_type,
       CASE WHEN again THEN first END AS refers_to, TRUE AS intact
FROM d
"""


ORACLE: dict[str, str] = {
    "op1_sharding": op1_sharding(),
    "op2_mixing": op2_mixing(),
    "op4_repeats": op4_repeats(),
    "op5_licences": op5_licences(),
    "op8_fingerprints": op8_fingerprints(),
    "op9_vectors": op9_vectors(),
    "op10_jaccard": op10_jaccard(),
    "op11_phrases": op11_phrases(),
    "op13_warc": op13_warc(),
}

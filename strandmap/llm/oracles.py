"""SQL for DuckDB that gives the rows of the queries which SQL can express, by other means than theirs:
whole lists of matches, all pairs of a label, recursion."""

from __future__ import annotations

from . import chat_format, sharding, simhash

# op1: base spans. The bootstrap adds none on the test tables; where it does, spans differs.


def _spans(kind: str, pattern: str, keep: str) -> str:
    """List of (start, end) of the matches m of a pattern that satisfy keep."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: struct_pack(
        m := regexp_extract_all(t, '{pattern}')[i],
        a := coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0))), lambda s: {keep}) AS {kind}"""


_DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN (length({_DIGITS}) - j) % 2 = 0 THEN CAST({_DIGITS}[j] AS BIGINT)
    ELSE (2 * CAST({_DIGITS}[j] AS BIGINT)) // 10 + (2 * CAST({_DIGITS}[j] AS BIGINT)) % 10 END)) % 10 = 0"""
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(s.m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS BIGINT) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_WRITTEN = " || ".join(f"coalesce(array_to_string(list_transform({k}, lambda s: ',{k}:' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + length(s.m) AS BIGINT)), ''), '')" for k in _KINDS)

PII = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, {", ".join(_spans(k, *v) for k, v in _KINDS.items())} FROM d),
    w AS (SELECT *, substr({_WRITTEN}, 2) AS spans FROM f)
    SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in _KINDS)}, sha256(spans) AS base_sha256, spans FROM w
"""

# op5: all pairs of a label

EMBEDDINGS = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
    l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.98
    ), r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
    c AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

# op6: every depth of the directory

SHARDS = f"""
    WITH r AS (
        SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
        FROM documents
    ), d AS (
        SELECT r.*, CAST(depth AS INTEGER) AS depth, h >> (60 - depth) AS bucket FROM r, range(0, 61) t(depth)
    ), s AS (
        SELECT *, sum(n_bytes) OVER (PARTITION BY depth, bucket) AS shard_bytes FROM d
    ), f AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM s WHERE shard_bytes <= {sharding.LIMIT} OR depth = 60
    )
    SELECT doc_id, n_bytes, depth, bucket, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM f WHERE k = 1
"""

# op8: XXH64 by its published definition, in 128-bit numbers, and all pairs of fingerprints

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MASK = "18446744073709551615::UHUGEINT"


def _cut(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _times(x: str, p: int) -> str:
    return _cut(f"({x}) * {p}::UHUGEINT")


def _turn(x: str, n: int) -> str:
    return _cut(f"(({x}) << {n}) | (({x}) >> {64 - n})")


def _round(acc: str, k: str) -> str:
    return _times(_turn(_cut(f"{acc} + {_times(k, P2)}"), 31), P1)


def _lane(i: int) -> str:
    start = {1: simhash.SEED + P1 + P2, 2: simhash.SEED + P2, 3: simhash.SEED, 4: simhash.SEED - P1}[i] % (1 << 64)
    return f"list_reduce(list_transform(range(0, n // 32), lambda q: w[4 * q + {i}]), lambda a, k: {_round('a', 'k')}, {start}::UHUGEINT) AS v{i}"


def _little(at: str, size: int) -> str:
    """The number that size bytes from place at (from 0) of the hex digits x write, lowest byte first."""
    return "CAST('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * j + 1}, 2)" for j in range(size - 1, -1, -1)) + " AS UHUGEINT)"


_MERGED = _cut(" + ".join(_turn(f"v{i}", n) for i, n in ((1, 1), (2, 7), (3, 12), (4, 18))))
for _i in (1, 2, 3, 4):
    _MERGED = f"list_reduce([v{_i}], lambda a, v: {_cut(_times('xor(a, ' + _round('0::UHUGEINT', 'v') + ')', P1) + f' + {P4}::UHUGEINT')}, {_MERGED})"
_EIGHT = _cut(_times(_turn(f"xor(a, {_round('0::UHUGEINT', 'k')})", 27), P1) + f" + {P4}::UHUGEINT")
_FOUR = _cut(_times(_turn(f"xor(h2, {_times(_little('n // 8 * 8', 4), P1)})", 23), P2) + f" + {P3}::UHUGEINT")
_ONE = _times(_turn(f"xor(a, {_times('k', P5)})", 11), P1)

SIMHASH = f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM t),
    b AS (SELECT s, hex(encode(s)) AS x, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM (SELECT DISTINCT s FROM g)),
    c AS (SELECT *, list_transform(range(0, n // 8), lambda q: {_little("8 * q", 8)}) AS w FROM b),
    v AS (SELECT *, {", ".join(map(_lane, (1, 2, 3, 4)))} FROM c),
    h0 AS (SELECT *, {_cut(f"CASE WHEN n >= 32 THEN {_MERGED} ELSE {(simhash.SEED + P5) % (1 << 64)}::UHUGEINT END + n::UHUGEINT")} AS h0 FROM v),
    h2 AS (SELECT s, x, n, list_reduce(w[n // 32 * 4 + 1:], lambda a, k: {_EIGHT}, h0) AS h2 FROM h0),
    h3 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {_FOUR} ELSE h2 END AS h3 FROM h2),
    h4 AS (SELECT s, list_reduce(list_transform(range(n // 4 * 4, n), lambda q: {_little("q", 1)}), lambda a, k: {_ONE}, h3) AS h FROM h3),
    h5 AS (SELECT s, {_times("xor(h, h >> 33)", P2)} AS h FROM h4),
    h6 AS (SELECT s, {_times("xor(h, h >> 29)", P3)} AS h FROM h5),
    h AS (SELECT s, xor(h, h >> 32)::UBIGINT AS h FROM h6),
    n AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))} FROM g JOIN h USING (s) GROUP BY 1),
    f AS (SELECT t.doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::UHUGEINT ELSE 0 END" for i in range(64))}, 0)::UBIGINT AS fp FROM t LEFT JOIN n USING (doc_id)),
    d AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY 1),
    l AS (SELECT a.fp AS a, b.fp AS b FROM d a JOIN d b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {simhash.THRESHOLD}),
    r AS (SELECT fp, least FROM d UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.fp),
    k AS (SELECT fp, min(least) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN k USING (fp)
"""

# op9: the turns and what the template adds to them

_MARKS = sum(map(len, chat_format.MARKERS))
_LONGER = " + ".join(f"len(regexp_extract_all({c}, '<\\\\*\\|'))" for c in ("role", "text"))

CHAT = f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), g AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{chat_format.LOSS_ROLE}'), '') AS learned,
            sum({_MARKS} + length(role) + length(text) + {_LONGER}) AS chars
        FROM c GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

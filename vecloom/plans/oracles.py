"""DuckDB SQL of the registered queries, written in long form: one row per coordinate, and the transform as its matrix product."""

from __future__ import annotations

D = 64
_VECTORS = "v AS (SELECT vec_id, label, CAST(vec_id % {n} AS INTEGER) AS client, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_SIGNS = "sg{d} AS (SELECT CAST(c AS INTEGER) AS client, i, CASE WHEN substr(md5('42:0:' || c || ':' || (i // 32)), CAST(i % 32 + 1 AS INTEGER), 1) < '8' THEN CAST(1 AS DOUBLE) ELSE -1 END AS s FROM range({n}) a(c), range({d}) b(i))"
_NMSE = "CASE WHEN sum({x} * {x}) = 0 THEN 0 ELSE sum(({x} - {h}) * ({x} - {h})) / sum({x} * {x}) END"


def _h(a: str, b: str) -> str:
    return f"(CASE WHEN bit_count({a} & {b}) % 2 = 0 THEN 1 ELSE -1 END)"


def _u(stream: int, entity: str, i: str = "i") -> str:
    return f"(CAST('0x' || substr(md5('42:{stream}:' || {entity} || ':' || ({i} // 4)), CAST({i} % 4 * 8 + 1 AS INTEGER), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


#: Index bits that one matrix product of a longer transform covers: H of 2^(a+b) is the Kronecker product of H of 2^a and of 2^b.
_BLOCK_BITS = 5


def _transform(name: str, source: str, value: str, keys: str, d: int, settled: bool = True) -> str:
    """name(keys, i, y): Walsh-Hadamard transform of source(keys, i, value); beyond 128 coordinates in blocks of index bits."""
    k = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    bits, parts, low = d.bit_length() - 1, [], 0
    while True:
        take = bits - low if d <= 128 else min(_BLOCK_BITS, bits - low)
        last = low + take == bits
        own = f"((t.i >> {low}) & {(1 << take) - 1})"
        at = f"(t.i - ({own} << {low}) + (b.i << {low}))"
        inner = f"sum(t.{value} * {_h(own, 'b.i')})" + (f" * (1 / sqrt(CAST({d} AS DOUBLE)))" if last else "")
        parts.append(f"{name if last else f'{name}_{low}'} AS (SELECT {k}, {at} AS i, {f'round_even({inner} * 1e9, 0) / 1e9' if settled and last else inner} AS y FROM {source} t, range({1 << take}) b(i) GROUP BY {k}, {at})")
        if last:
            return ", ".join(parts)
        source, value, low = f"{name}_{low}", "y", low + take


def _rotated(n: int = 1, d: int = D, vectors: str | None = None) -> str:
    return ", ".join([vectors or _VECTORS.format(n=n), _SIGNS.format(n=n, d=d), f"r AS (SELECT vec_id, label, client, i, x * s AS x FROM v JOIN sg{d} USING (client, i))", _transform("y", "r", "x", "vec_id, label, client", d)])


_SCALE = "m AS (SELECT vec_id, client, CASE WHEN sum(abs(y)) = 0 THEN 0 ELSE sum(y * y) / sum(abs(y)) END AS scale FROM y GROUP BY vec_id, client)"
_SIGN_Q = "q AS (SELECT y.vec_id, y.label, y.client, y.i, CASE WHEN y < 0 THEN -scale ELSE scale END AS q FROM y JOIN m USING (vec_id, client))"


def _two_means(rounds: int, source: str = "y", key: str = "vec_id, client") -> list[str]:
    """t0..: splits; the last has c0, c1, n0, n1, cut."""
    on = " AND ".join(f"a.{c.strip()} = {source}.{c.strip()}" for c in key.split(","))
    ks = ", ".join(f"a.{c.strip()}" for c in key.split(","))
    out = [f"b0 AS (SELECT {key}, count(*) AS n, sum(y) AS s, sum(y) / count(*) AS cut FROM {source} GROUP BY {key})"]
    for k in range(rounds + 1):
        out.append(f"s{k} AS (SELECT {ks}, a.n, a.s, a.cut, count(*) FILTER (y < a.cut) AS n0, coalesce(sum(y) FILTER (y < a.cut), 0) AS s0 FROM {source} JOIN b{k} a ON {on} GROUP BY {ks}, a.n, a.s, a.cut)")
        whole = "n0 = 0 OR n0 = n"
        out.append(f"t{k} AS (SELECT *, CASE WHEN {whole} THEN s / n ELSE s0 / n0 END AS c0, CASE WHEN {whole} THEN s / n ELSE (s - s0) / (n - n0) END AS c1, n - n0 AS n1 FROM s{k})")
        out.append(f"b{k + 1} AS (SELECT {key}, n, s, (c0 + c1) / 2 AS cut FROM t{k})")
    return out


def _energy(t: str) -> str:
    return f"({t}.n0 * {t}.c0 * {t}.c0 + {t}.n1 * {t}.c1 * {t}.c1)"


def _decoded(n: int = 1, d: int = D, keys: str = "vec_id, label, client", length: int = D) -> str:
    return ", ".join([_transform("z", "q", "q", keys, d, False), f"h AS (SELECT {keys}, i, y * s AS xh FROM z JOIN sg{d} USING (client, i) WHERE i < {length})"])


_COMPARE = f"SELECT v.vec_id, round({_NMSE.format(x='v.x', h='h.xh')}, 6) + 0.0 AS nmse, round(sum(h.xh), 4) + 0.0 AS total FROM v JOIN h ON h.vec_id = v.vec_id AND h.i = v.i GROUP BY v.vec_id"
_TWO_Q = "w AS (SELECT y.vec_id, y.client, CASE WHEN {e} = 0 THEN 0 ELSE sum(y * y) / {e} END AS f FROM y JOIN {t} USING (vec_id, client) GROUP BY y.vec_id, y.client, {t}.n0, {t}.n1, {t}.c0, {t}.c1), q AS (SELECT y.vec_id, y.label, y.client, y.i, CASE WHEN {up} THEN f * {t}.c1 ELSE f * {t}.c0 END AS q FROM y JOIN {t} USING (vec_id, client) JOIN w USING (vec_id, client))"


def _two_q(t: str, up: str) -> str:
    return _TWO_Q.format(e=_energy(t), t=t, up=up)


_SPLIT = "t AS (SELECT vec_id, client, cut, n0, n - n0 AS n1, CASE WHEN n0 = 0 OR n0 = n THEN s / n ELSE s0 / n0 END AS c0, CASE WHEN n0 = 0 OR n0 = n THEN s / n ELSE (s - s0) / (n - n0) END AS c1 FROM (SELECT vec_id, client, cut, n, s, count(*) FILTER (y <= cut) AS n0, coalesce(sum(y) FILTER (y <= cut), 0) AS s0 FROM (SELECT *, sum(y) OVER w AS s, count(*) OVER w AS n, sum(y) OVER w / count(*) OVER w AS cut FROM y WINDOW w AS (PARTITION BY vec_id)) GROUP BY vec_id, client, cut, n, s))"
_LEVELS = "rg AS (SELECT vec_id, client, min(y) AS low, max(y) - min(y) AS span FROM y GROUP BY vec_id, client), p AS (SELECT y.vec_id, y.label, y.client, y.i, low, span, CASE WHEN span = 0 THEN 0 ELSE (y - low) / span END AS p FROM y JOIN rg USING (vec_id, client)), q AS (SELECT vec_id, label, client, i, low + span * (floor(p) + CASE WHEN " + _u(1, "client || '.' || vec_id") + " < p - floor(p) THEN 1 ELSE 0 END) AS q FROM p)"

_LEVELS_4 = _LEVELS.replace("(y - low) / span END AS p", "(y - low) / span END * 15 AS p").replace("span * (floor(p)", "span / 15 * (floor(p)")


def _kashin(d: int = D, n: int = 1, vectors: str | None = None) -> str:
    p = 2 * d
    parts = [vectors or _VECTORS.format(n=n), _SIGNS.format(n=n, d=p), f"r0 AS (SELECT e.vec_id, e.label, e.client, g.i, coalesce(v.x, 0) AS x FROM (SELECT DISTINCT vec_id, label, client FROM v) e, range({p}) g(i) LEFT JOIN v ON v.vec_id = e.vec_id AND v.client = e.client AND v.i = g.i)",
             f"m0 AS (SELECT vec_id, client, sqrt(sum(x * x)) / sqrt(CAST({p} AS DOUBLE)) AS m FROM v GROUP BY vec_id, client)"]
    for k in range(3):
        parts += [f"d{k} AS (SELECT vec_id, label, client, i, x * s AS x FROM r{k} JOIN sg{p} USING (client, i))", _transform(f"f{k}", f"d{k}", "x", "vec_id, label, client", p, False),
                  f"c{k} AS (SELECT vec_id, label, client, i, greatest(-m * {0.9**k!r}, least(m * {0.9**k!r}, y)) AS y FROM f{k} f JOIN m0 USING (vec_id, client))"]
        if k < 2:
            parts += [_transform(f"g{k}", f"c{k}", "y", "vec_id, label, client", p, False), f"r{k + 1} AS (SELECT a.vec_id, a.label, a.client, a.i, a.x - b.y * s AS x FROM r{k} a JOIN g{k} b ON a.vec_id = b.vec_id AND a.client = b.client AND a.i = b.i JOIN sg{p} g ON g.client = a.client AND g.i = a.i)"]
    parts += ["y AS (SELECT vec_id, label, client, i, round_even(sum(y) * 1e9, 0) / 1e9 AS y FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY vec_id, label, client, i)", _LEVELS, _decoded(n, p, length=d)]
    return ", ".join(parts)


def _ternary(limit: str, scale: str) -> str:
    return f"""WITH {_VECTORS.format(n=1)}, sd AS (SELECT vec_id, stddev_samp(x) AS ss, stddev_pop(x) AS sp FROM v GROUP BY vec_id),
c AS (SELECT v.vec_id, client, i, x, greatest(-({limit}), least({limit}, x)) AS c, {limit} AS th FROM v JOIN sd ON sd.vec_id = v.vec_id),
a AS (SELECT vec_id, max(abs(c)) AS a FROM c GROUP BY vec_id),
h AS (SELECT c.vec_id, i, x, {scale} * CASE WHEN {_u(1, "client || '.' || c.vec_id")} < CASE WHEN a = 0 THEN 0 ELSE abs(c) / a END THEN sign(c) ELSE 0 END AS xh FROM c JOIN a ON a.vec_id = c.vec_id)
SELECT vec_id, round({_NMSE.format(x='x', h='xh')}, 6) + 0.0 AS nmse, round(sum(xh), 4) + 0.0 AS total FROM h GROUP BY vec_id"""


_LAYERED = f"""WITH {_VECTORS.format(n=1)}, l AS (SELECT *, CASE WHEN i < 40 THEN 0 ELSE 1 END AS k, CASE WHEN i < 40 THEN i ELSE i - 40 END AS j FROM v),
sd AS (SELECT vec_id, k, 2.5 * stddev_samp(x) AS th FROM l GROUP BY vec_id, k),
c AS (SELECT l.vec_id, client, l.k, j, x, greatest(-th, least(th, x)) AS c FROM l JOIN sd ON sd.vec_id = l.vec_id AND sd.k = l.k),
a AS (SELECT vec_id, k, max(abs(c)) AS a FROM c GROUP BY vec_id, k),
h AS (SELECT c.vec_id, x, a * CASE WHEN {_u(1, "client || '.' || c.vec_id || '/' || c.k", "j")} < CASE WHEN a = 0 THEN 0 ELSE abs(c) / a END THEN sign(c) ELSE 0 END AS xh FROM c JOIN a ON a.vec_id = c.vec_id AND a.k = c.k)
SELECT vec_id, round({_NMSE.format(x='x', h='xh')}, 6) + 0.0 AS nmse, round(sum(xh), 4) + 0.0 AS total FROM h GROUP BY vec_id"""


def _grid(tail: str) -> str:
    return f"""WITH {_rotated()}, rg AS (SELECT vec_id, min(y) AS low, max(y) - min(y) AS s1, sqrt(2.0 * sum(y * y)) AS s2 FROM y GROUP BY vec_id),
g AS (SELECT CAST(b AS INTEGER) AS bits, n AS normalisation FROM range(1, 13) a(b), (VALUES ('minmax'), ('sqrt2norm')) c(n)),
p AS (SELECT y.vec_id, y.i, y, bits, normalisation, low, CASE WHEN normalisation = 'minmax' THEN s1 ELSE s2 END AS span, {_u(1, "y.client || '.' || y.vec_id", "y.i")} AS u FROM y JOIN rg ON rg.vec_id = y.vec_id, g),
o AS (SELECT *, CASE WHEN span = 0 THEN 0 ELSE (y - low) / span END * (pow(2.0, bits) - 1) AS p FROM p),
q AS (SELECT *, floor(p) + CASE WHEN u < p - floor(p) THEN 1 ELSE 0 END AS level FROM o) {tail}"""


def _bucket(row: str, key: str, cols: int) -> str:
    return f"(CAST('0x' || substr(md5('42:4:' || {row} || ':' || {key}), 1, 8) AS BIGINT) % {cols})"


def _sketch_sign(row: str, key: str) -> str:
    return f"(CASE WHEN substr(md5('42:5:' || {row} || ':' || {key}), 1, 1) < '8' THEN 1 ELSE -1 END)"


def _sketch(source: str, key: str, value: str, rows: int, cols: int) -> str:
    return f"SELECT CAST(r AS INTEGER) AS row, {_bucket('r', key, cols)} AS bucket, sum({_sketch_sign('r', key)} * {value}) AS value FROM {source}, range({rows}) t(r) WHERE {value} IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2"


def _unsketch(table: str) -> str:
    return f"SELECT user_id, median({_sketch_sign('r', 'user_id')} * coalesce(s.value, 0)) AS estimate FROM (SELECT DISTINCT user_id FROM events) k CROSS JOIN range(5) t(r) LEFT JOIN {table} s ON s.row = r AND s.bucket = {_bucket('r', 'user_id', 97)} GROUP BY user_id"


_FETCH = f"""WITH g1 AS (SELECT row, bucket, round(value, 6) AS value FROM ({_sketch("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')", 'user_id', 'value', 5, 97)})),
g2 AS (SELECT row, bucket, round(value, 6) AS value FROM ({_sketch("(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')", 'user_id', 'value', 5, 97)})),
e1 AS (SELECT * FROM g1), x1 AS ({_unsketch('e1')}), u1 AS (SELECT user_id, estimate AS value FROM x1 ORDER BY abs(estimate) DESC, user_id LIMIT 10),
h1 AS (SELECT row, bucket FROM ({_sketch('u1', 'user_id', 'value', 5, 97)}) WHERE value <> 0), k1 AS (SELECT * FROM e1 ANTI JOIN h1 USING (row, bucket)),
m2 AS (SELECT row, bucket, sum(value) AS value FROM (SELECT row, bucket, 0.9 * value AS value FROM g1 UNION ALL SELECT * FROM g2) GROUP BY row, bucket),
e2 AS (SELECT row, bucket, sum(value) AS value FROM (SELECT * FROM k1 UNION ALL SELECT * FROM m2) GROUP BY row, bucket), x2 AS ({_unsketch('e2')})
SELECT user_id, round(estimate, 4) + 0.0 AS value FROM x2 ORDER BY abs(estimate) DESC, user_id LIMIT 10"""


def _kmeans(rounds: int, codec: str = "identity", tail: str | None = None) -> str:
    parts = [_VECTORS.format(n=10), f"k0 AS (SELECT c, i, 2 * {_u(3, 'c')} - 1 AS z FROM range(10) a(c), range({D}) b(i))"]
    for k in range(rounds):
        parts += [f"e{k} AS (SELECT vec_id, client, c, round(sum((x - z) * (x - z)), 12) AS dist FROM v JOIN k{k} USING (i) GROUP BY vec_id, client, c)",
                  f"a{k} AS (SELECT vec_id, client, arg_min(c, (dist, c)) AS c FROM e{k} GROUP BY vec_id, client)", f"n{k} AS (SELECT c, count(*) AS mass FROM a{k} GROUP BY c)",
                  f"p{k} AS (SELECT a.client, a.c * {D} + v.i AS i, sum(x) AS x FROM a{k} a JOIN v USING (vec_id) GROUP BY 1, 2)"]
        total = f"(SELECT i, sum(x) AS x FROM p{k} GROUP BY i)"
        if codec != "identity":
            parts += [_SIGNS.format(n=10, d=1024), f"w{k} AS (SELECT client, i, x * s AS x FROM p{k} JOIN sg1024 USING (client, i))", _transform("y", f"w{k}", "x", "client", 1024)]
            if codec == "sign":
                parts += ["m AS (SELECT client, sum(y * y) / sum(abs(y)) AS scale FROM y GROUP BY client)", "q AS (SELECT client, i, CASE WHEN y < 0 THEN -scale ELSE scale END AS q FROM y JOIN m USING (client))"]
            else:
                parts += [*_two_means(3, "y", "client"), f"w AS (SELECT y.client, sum(y * y) / {_energy('t3')} AS f FROM y JOIN t3 USING (client) GROUP BY y.client, t3.n0, t3.n1, t3.c0, t3.c1)", "q AS (SELECT y.client, y.i, CASE WHEN y >= cut THEN f * c1 ELSE f * c0 END AS q FROM y JOIN t3 USING (client) JOIN w USING (client))"]
            parts += [_transform("z", "q", "q", "client", 1024, False)]
            total = "(SELECT z.i, sum(y * s) AS x FROM z JOIN sg1024 USING (client, i) GROUP BY z.i)"
        parts.append(f"k{k + 1} AS (SELECT c, b.i, CASE WHEN coalesce(mass, 0) = 0 THEN 0 ELSE coalesce(t.x, 0) / mass END AS z FROM range(10) a(c) CROSS JOIN range({D}) b(i) LEFT JOIN n{k} USING (c) LEFT JOIN {total} t ON t.i = c * {D} + b.i)")
    if tail:
        return f"WITH {', '.join(parts)} {tail}"
    return f"WITH {', '.join(parts)} SELECT CAST(c AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, round(z, 6) + 0.0 AS value FROM k{rounds}"


def _power(rounds: int, codec: str, lr: float, tail: str | None = None) -> str:
    parts = [_VECTORS.format(n=10), _SIGNS.format(n=10, d=D), "mu AS (SELECT i, avg(x) AS m FROM v GROUP BY i)", "c AS (SELECT vec_id, client, v.i, x - m AS x FROM v JOIN mu USING (i))",
             f"w0 AS (SELECT i, 1 / sqrt(CAST({D} AS DOUBLE)) AS w FROM range({D}) a(i))", f"s0 AS (SELECT CAST(k AS INTEGER) AS client, i, CAST(0 AS DOUBLE) AS st FROM range(10) a(k), range({D}) b(i))"]
    for k in range(rounds):
        parts += [f"d{k} AS (SELECT vec_id, sum(x * w) AS d FROM c JOIN w{k} USING (i) GROUP BY vec_id)", f"t{k} AS (SELECT client, i, sum(d * x) AS t FROM c JOIN d{k} USING (vec_id) GROUP BY client, i)",
                  f"x{k} AS (SELECT client, i, t - st AS x FROM t{k} JOIN s{k} USING (client, i))"]
        if codec == "sign":
            parts += [f"r{k} AS (SELECT client, i, x * s AS x FROM x{k} JOIN sg{D} USING (client, i))", _transform(f"y{k}", f"r{k}", "x", "client", D),
                      f"m{k} AS (SELECT client, sum(y * y) / sum(abs(y)) AS scale FROM y{k} GROUP BY client)", f"q{k} AS (SELECT client, i, CASE WHEN y < 0 THEN -scale ELSE scale END AS q FROM y{k} JOIN m{k} USING (client))",
                      _transform(f"z{k}", f"q{k}", "q", "client", D, False), f"h{k} AS (SELECT client, i, y * s AS x FROM z{k} JOIN sg{D} USING (client, i))"]
        else:
            parts.append(f"h{k} AS (SELECT * FROM x{k})")
        parts += [f"s{k + 1} AS (SELECT client, i, st + {lr} * h.x AS st FROM s{k} JOIN h{k} h USING (client, i))", f"u{k} AS (SELECT i, sum(st) AS u FROM s{k + 1} GROUP BY i)",
                  f"w{k + 1} AS (SELECT i, u / sqrt(sum(u * u) OVER ()) AS w FROM u{k})"]
    if tail:
        return f"WITH {', '.join(parts)} {tail}"
    return f"WITH {', '.join(parts)} SELECT CAST(i AS INTEGER) AS i, round(w, 6) + 0.0 AS value FROM w{rounds}"


def _federated(codec: str, weighted: bool) -> str:
    parts = [_VECTORS.format(n=10), f"b AS (SELECT vec_id, label, client, i, x FROM v UNION ALL SELECT DISTINCT vec_id, label, client, {D}, CAST(1 AS DOUBLE) FROM v)",
             f"g AS (SELECT client, c * {D + 1} + i AS i, avg((CAST(1 AS DOUBLE) / 10 - CASE WHEN c = label THEN 1 ELSE 0 END) * x) AS x FROM b, range(10) a(c) GROUP BY 1, 2)",
             "n AS (SELECT client, count(DISTINCT vec_id) AS n FROM v GROUP BY client)"]
    if codec == "sign":
        parts += [_SIGNS.format(n=10, d=1024), "r AS (SELECT client, i, x * s AS x FROM g JOIN sg1024 USING (client, i))", _transform("y", "r", "x", "client", 1024),
                  "m AS (SELECT client, sum(y * y) / sum(abs(y)) AS scale FROM y GROUP BY client)", "q AS (SELECT client, i, CASE WHEN y < 0 THEN -scale ELSE scale END AS q FROM y JOIN m USING (client))",
                  _transform("z", "q", "q", "client", 1024, False), "h AS (SELECT client, i, y * s AS x FROM z JOIN sg1024 USING (client, i))"]
    else:
        parts.append("h AS (SELECT * FROM g)")
    mean = "sum(n * x) / sum(n)" if weighted else "avg(x)"
    return f"WITH {', '.join(parts)} SELECT CAST(i // {D + 1} AS INTEGER) AS cluster, CAST(i % {D + 1} AS INTEGER) AS i, round(-({mean}), 6) + 0.0 AS value FROM h JOIN n USING (client) WHERE h.i < {10 * (D + 1)} GROUP BY h.i"


def _training(rounds: int, codec: str, tail: str) -> str:
    parts = [_VECTORS.format(n=10), f"b AS MATERIALIZED (SELECT vec_id, label, client, i, x FROM v UNION ALL SELECT DISTINCT vec_id, label, client, {D}, CAST(1 AS DOUBLE) FROM v)",
             "n AS (SELECT client, count(DISTINCT vec_id) AS n FROM v GROUP BY client)", _SIGNS.format(n=10, d=1024),
             f"w0 AS MATERIALIZED (SELECT c, i, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS vel FROM range(10) a(c), range({D + 1}) b(i))"]
    for k in range(rounds):
        parts += [f"z{k} AS (SELECT vec_id, c, sum(x * w) AS z FROM b JOIN w{k} USING (i) GROUP BY vec_id, c)", f"x{k} AS (SELECT vec_id, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z{k})",
                  f"p{k} AS (SELECT vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x{k})",
                  f"g{k} AS (SELECT client, c * {D + 1} + i AS i, avg((p - CASE WHEN c = label THEN 1 ELSE 0 END) * x) AS x FROM b JOIN p{k} USING (vec_id) GROUP BY 1, 2)"]
        if codec == "sign":
            parts += [f"r{k} AS (SELECT client, i, x * s AS x FROM g{k} JOIN sg1024 USING (client, i))", _transform(f"y{k}", f"r{k}", "x", "client", 1024),
                      f"m{k} AS (SELECT client, sum(y * y) / sum(abs(y)) AS scale FROM y{k} GROUP BY client)", f"q{k} AS (SELECT client, i, CASE WHEN y < 0 THEN -scale ELSE scale END AS q FROM y{k} JOIN m{k} USING (client))",
                      _transform(f"t{k}", f"q{k}", "q", "client", 1024, False), f"h{k} AS (SELECT client, i, y * s AS x FROM t{k} JOIN sg1024 USING (client, i))"]
        else:
            parts.append(f"h{k} AS (SELECT * FROM g{k})")
        parts += [f"d{k} AS (SELECT i // {D + 1} AS c, i % {D + 1} AS i, sum(n * x) / sum(n) AS g FROM h{k} JOIN n USING (client) WHERE h{k}.i < {10 * (D + 1)} GROUP BY h{k}.i)",
                  f"u{k} AS (SELECT c, i, w, 0.9::DOUBLE * vel + g + 5e-4::DOUBLE * w AS vel FROM w{k} JOIN d{k} USING (c, i))", f"w{k + 1} AS MATERIALIZED (SELECT c, i, w - 0.1::DOUBLE * vel AS w, vel FROM u{k})"]
    return f"WITH {', '.join(parts)} {tail}"


def _accuracy(k: int) -> str:
    return f"SELECT {k} AS round, round(100 * avg(CASE WHEN c = label THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy FROM (SELECT vec_id, label, arg_max(c, (z, -c)) AS c FROM (SELECT vec_id, label, c, sum(x * w) AS z FROM b JOIN w{k + 1} USING (i) GROUP BY vec_id, label, c) GROUP BY vec_id, label)"


_WEIGHTS = "SELECT CAST(c AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, round(w, 6) + 0.0 AS value FROM w3"
_COIN = f"""WITH {_VECTORS.format(n=1)}, y AS (SELECT vec_id, client, i, round_even(x * 10, 0) / 10 AS y FROM v),
b AS (SELECT vec_id, i, y, CASE WHEN y < 0 THEN 0 WHEN y > 0 THEN 1 WHEN {_u(1, "client || '.' || vec_id")} < 0.5 THEN 0 ELSE 1 END AS b FROM y)
SELECT vec_id, round(CASE WHEN sum(y * (2 * b - 1)) = 0 THEN 0 ELSE sum(y * y) / sum(y * (2 * b - 1)) END, 4) + 0.0 AS scale, string_agg(CAST(b AS VARCHAR), '' ORDER BY i) AS bits FROM b GROUP BY vec_id"""
_GATED = f"""WITH v AS (SELECT * FROM (SELECT vec_id, label, 0 AS client, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < vec_id % 49 + 16),
{_SIGNS.format(n=1, d=D)}, r AS (SELECT vec_id, label, client, i, x * s AS x FROM v JOIN sg{D} USING (client, i)), {_transform("y", "r", "x", "vec_id, label, client", D)}, {_SCALE}, {_SIGN_Q}, {_decoded()}
SELECT v.vec_id, CAST(count(*) AS INTEGER) AS n, CASE WHEN count(*) <= 32 THEN 0 ELSE round({_NMSE.format(x='v.x', h='h.xh')}, 6) END + 0.0 AS nmse FROM v JOIN h ON h.vec_id = v.vec_id AND h.i = v.i GROUP BY v.vec_id"""


def _fetch_variables() -> str:
    """As _FETCH, with the spec's number of buckets (the smallest prime above a 32nd of the size), and variables of up to 24 keys (hours) as they are."""
    prime = "(SELECT min(p) FROM range(1 + (SELECT (max(user_id) + 1) // 32 FROM events), 2 * (SELECT (max(user_id) + 1) // 32 FROM events) + 5) a(p) WHERE p > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 100000) b(q) WHERE q < p AND p % q = 0))"
    body = _FETCH.replace("round(value, 6) AS value", "value").replace("% 97", "% (SELECT cols FROM cols)").replace("WITH g1", f"WITH cols AS MATERIALIZED (SELECT {prime} AS cols), g1", 1)
    plain = "SELECT '{name}' AS variable, {key} AS key, round(sum(value), 4) + 0.0 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY {key}"
    small = "(SELECT max(user_id) + 1 <= 24 FROM events)"
    return f"SELECT 'user' AS variable, user_id AS key, value FROM ({body}) WHERE NOT {small} UNION ALL SELECT * FROM ({plain.format(name='user', key='user_id')}) WHERE {small} UNION ALL {plain.format(name='hour', key='hour(ts)')}"


def _synthetic(dist: str, d: int, trials: int, n: int = 1) -> str:
    """v: hash-random vectors, the same for each of n clients."""
    e = f"'{dist}-{d}-' || t"
    normal = f"sqrt(-2 * ln(1 - {_u(2, e, '(2 * i)')})) * cos(2 * pi() * {_u(2, e, '(2 * i + 1)')})"
    x = {"lognormal": f"exp({normal})", "normal": normal, "exponential": f"-ln(1 - {_u(2, e)})"}[dist]
    return f"v0 AS (SELECT t AS vec_id, 0 AS label, i, {x} AS x FROM range({trials}) p(t), range({d}) q(i)), v AS MATERIALIZED (SELECT vec_id, label, CAST(c AS INTEGER) AS client, i, x FROM v0, range({n}) a(c))"


_TERNARY = f"""a AS (SELECT vec_id, client, max(abs(x)) AS a FROM v GROUP BY vec_id, client),
h AS (SELECT vec_id, label, client, i, a * CASE WHEN {_u(1, "client || '.' || vec_id")} < CASE WHEN a = 0 THEN 0 ELSE abs(x) / a END THEN sign(x) ELSE 0 END AS xh FROM v JOIN a USING (vec_id, client))"""


def _codec(name: str, d: int, vectors: str, n: int = 1) -> str:
    """v and h(vec_id, label, client, i, xh): the vectors (d a power of two) and their decoded messages."""
    if name == "terngrad":
        return f"{vectors}, {_TERNARY}"
    if name == "kashin_sq":
        return _kashin(d, n, vectors)
    quantised = {"sign": f"{_SCALE}, {_SIGN_Q}", "two_means": f"{', '.join(_two_means(3))}, {_two_q('t3', 'y >= t3.cut')}", "hadamard_sq": _LEVELS}[name]
    return f"{_rotated(n, d, vectors)}, {quantised}, {_decoded(n, d, length=d)}"


def _report() -> str:
    names = ("sign", "two_means", "hadamard_sq", "kashin_sq", "terngrad")
    one = [f"SELECT {d} AS dim, '{c}' AS codec, avg(nmse) AS nmse FROM (WITH {_codec(c, d, _synthetic('lognormal', d, 50))} SELECT v.vec_id, {_NMSE.format(x='v.x', h='h.xh')} AS nmse FROM v JOIN h USING (vec_id, i) GROUP BY v.vec_id)" for d in (16, 64, 128) for c in names]
    cells = ", ".join(f"round(max(nmse) FILTER (codec = '{c}'), 6) + 0.0 AS {c}" for c in names)
    return f"SELECT dim, {cells} FROM ({' UNION ALL '.join(one)}) GROUP BY dim"


def _table() -> str:
    one = []
    for d in (128, 1024, 8192):
        for c in ("sign", "two_means", "hadamard_sq", "kashin_sq"):
            one.append(f"SELECT {d} AS dim, '{c}' AS codec, nmse FROM (WITH {_codec(c, d, _synthetic('lognormal', d, 10, 10), 10)}, e AS (SELECT vec_id, i, avg(xh) AS xh FROM h GROUP BY vec_id, i) SELECT vec_id, {_NMSE.format(x='v0.x', h='e.xh')} AS nmse FROM v0 JOIN e USING (vec_id, i) GROUP BY vec_id)")
    return f"SELECT dim, codec, round(avg(nmse), 5) + 0.0 AS mean, round(stddev_samp(nmse), 5) + 0.0 AS std, count(*) AS trials FROM ({' UNION ALL '.join(one)}) GROUP BY dim, codec"


def _figure() -> str:
    one = []
    for dist in ("lognormal", "normal", "exponential"):
        for d in (2**k for k in range(2, 12)):
            energy = _energy("t3")
            one.append(f"""SELECT '{dist}' AS distribution, {d} AS dim, unnest(['sign', 'two_means']) AS codec, unnest([a, b]) AS nmse FROM (WITH {_rotated(1, d, _synthetic(dist, d, 40))}, {', '.join(_two_means(3))}
SELECT vec_id, {d} * sum(y * y) / (sum(abs(y)) * sum(abs(y))) - 1 AS a, sum(y * y) / {energy} - 1 AS b FROM y JOIN t3 USING (vec_id, client) GROUP BY vec_id, t3.n0, t3.n1, t3.c0, t3.c1)""")
    return f"SELECT distribution, dim, codec, round(avg(nmse), 5) + 0.0 AS mean, round(stddev_samp(nmse), 5) + 0.0 AS std FROM ({' UNION ALL '.join(one)}) GROUP BY distribution, dim, codec"


def _uniform_rotation(tail: str) -> str:
    """exact and, settled, y: the embeddings after a product of Householder reflections of hash-Gaussian vectors, each a step of the recursion."""
    e = f"'urr-{D}-' || k"
    normal = f"sqrt(-2 * ln(1 - {_u(2, e, '(2 * j)')})) * cos(2 * pi() * {_u(2, e, '(2 * j + 1)')})"
    return f"""WITH RECURSIVE {_VECTORS.format(n=1)}, g AS (SELECT k, k + j AS i, {normal} AS g FROM range({D}) a(k), range({D}) b(j) WHERE j < {D} - k),
f AS (SELECT k, CASE WHEN arg_min(g, i) < 0 THEN -1 ELSE 1 END AS s, sqrt(sum(g * g)) AS n FROM g GROUP BY k),
o AS (SELECT CASE WHEN count(*) FILTER (k < {D - 1} AND s > 0 OR k = {D - 1} AND s < 0) % 2 = {(D - 1) % 2} THEN 1 ELSE -1 END AS o FROM f),
u AS MATERIALIZED (SELECT k, list(CASE WHEN x.i < k THEN 0 WHEN x.i = k THEN g + s * n ELSE g END ORDER BY x.i) AS u FROM (SELECT k, i, s, n FROM f, range({D}) c(i) WHERE k < {D - 1}) x LEFT JOIN g USING (k, i) GROUP BY k),
d AS (SELECT k AS i, CASE WHEN k = {D - 1} THEN s ELSE -s END * CASE WHEN k = 0 THEN o ELSE 1 END AS s FROM f, o),
p AS (SELECT vec_id, {D - 1} AS k, list(x * s ORDER BY i) AS x FROM v JOIN d USING (i) GROUP BY vec_id
UNION ALL SELECT vec_id, k, list_transform(list_zip(x, u), lambda z: z[1] - c * z[2]) FROM (SELECT p.vec_id, p.x, u.k, u.u, 2 * list_dot_product(p.x, u.u) / list_dot_product(u.u, u.u) AS c FROM p JOIN u ON u.k = p.k - 1)),
y AS MATERIALIZED (SELECT vec_id, 0 AS label, 0 AS client, unnest(range({D})) AS i, unnest(x) AS exact, round_even(unnest(x) * 1e9, 0) / 1e9 AS y FROM p WHERE k = 0), {tail}
SELECT vec_id, round({_NMSE.format(x='exact', h='q')}, 6) + 0.0 AS nmse FROM y JOIN q USING (vec_id, i) GROUP BY vec_id"""


_HIST = "n AS (SELECT bits, normalisation, level, count(*) AS n FROM q GROUP BY ALL)"

ORACLE_SQL = {
    "sign_encode": f"WITH {_rotated()}, {_SCALE} SELECT y.vec_id, round(any_value(scale), 6) + 0.0 AS scale, string_agg(CASE WHEN y < 0 THEN '0' ELSE '1' END, '' ORDER BY i) AS bits FROM y JOIN m ON m.vec_id = y.vec_id GROUP BY y.vec_id",
    "sign_nmse": f"WITH {_rotated()} SELECT vec_id, round(CASE WHEN sum(abs(y)) = 0 THEN 0 ELSE {D} * sum(y * y) / (sum(abs(y)) * sum(abs(y))) - 1 END, 6) + 0.0 AS nmse FROM y GROUP BY vec_id",
    "identity_roundtrip": f"WITH {_VECTORS.format(n=1)} SELECT vec_id, CAST(0 AS DOUBLE) AS nmse, round(sum(x), 4) + 0.0 AS total FROM v GROUP BY vec_id",
    "sign_roundtrip": f"WITH {_rotated()}, {_SCALE}, {_SIGN_Q}, {_decoded()} {_COMPARE}",
    "two_means_encode": f"WITH {_rotated()}, {', '.join(_two_means(3))}, {_two_q('t3', 'y >= t3.cut')} SELECT t3.vec_id, round(f * c0, 6) + 0.0 AS c0, round(f * c1, 6) + 0.0 AS c1, n0, n1, (SELECT string_agg(CASE WHEN y >= t3.cut THEN '1' ELSE '0' END, '' ORDER BY i) FROM y WHERE y.vec_id = t3.vec_id) AS bits FROM t3 JOIN w ON w.vec_id = t3.vec_id",
    "two_means_nmse": f"WITH {_rotated()}, {', '.join(_two_means(3))} SELECT y.vec_id, round(CASE WHEN {_energy('t3')} = 0 THEN 0 ELSE sum(y * y) / {_energy('t3')} - 1 END, 6) + 0.0 AS nmse FROM y JOIN t3 ON t3.vec_id = y.vec_id GROUP BY y.vec_id, t3.n0, t3.n1, t3.c0, t3.c1",
    "two_means_converged": f"WITH {_rotated()}, {', '.join(_two_means(24))} SELECT vec_id, n0, n1, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM t24",
    "two_means_roundtrip": f"WITH {_rotated()}, {', '.join(_two_means(3))}, {_two_q('t3', 'y >= t3.cut')}, {_decoded()} {_COMPARE}",
    "split_at_mean_encode": f"WITH {_rotated()}, {_SPLIT}, {_two_q('t', 'y > t.cut')} SELECT t.vec_id, round(f * c0, 6) + 0.0 AS c0, round(f * c1, 6) + 0.0 AS c1, n0, n1 FROM t JOIN w ON w.vec_id = t.vec_id",
    "split_at_mean_roundtrip": f"WITH {_rotated()}, {_SPLIT}, {_two_q('t', 'y > t.cut')}, {_decoded()} {_COMPARE}",
    "hadamard_sq_roundtrip": f"WITH {_rotated()}, {_LEVELS}, {_decoded()} {_COMPARE}",
    "hadamard_4bit_roundtrip": f"WITH {_rotated()}, {_LEVELS_4}, {_decoded()} {_COMPARE}",
    "two_means_lloyd_roundtrip": f"WITH {_rotated()}, {', '.join(_two_means(24))}, {_two_q('t24', 'y >= t24.cut')}, {_decoded()} {_COMPARE}",
    "packed_sign": f"WITH {_rotated()}, {_SCALE}, {_SIGN_Q}, {_decoded()} {_COMPARE}",
    "sketch_mean": f"WITH s0 AS ({_sketch('events', 'user_id', 'value', 5, 97)}), e AS (SELECT user_id, round(estimate / (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events), 4) + 0.0 AS estimate FROM ({_unsketch('s0')})) SELECT * FROM e ORDER BY abs(estimate) DESC, user_id LIMIT 20",
    "accuracy_epochs": "SELECT hour, round(share * 100, 6) + 0.0 AS share FROM (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS hour, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*) AS share FROM events GROUP BY 1) WHERE hour BETWEEN 100 AND 200",
    "kashin_sq_roundtrip": f"WITH {_kashin()} {_COMPARE}",
    "terngrad_roundtrip": _ternary("CAST('inf' AS DOUBLE)", "a"),
    "terngrad_clipped_roundtrip": _ternary("2.5 * ss", "th"),
    "terngrad_population_roundtrip": _ternary("2.5 * sp", "a"),
    "terngrad_layered_roundtrip": _LAYERED,
    "bitpack": f"WITH {_rotated()} SELECT vec_id, CAST(sum(CASE WHEN y < 0 OR i >= 32 THEN 0 ELSE CAST(1 AS BIGINT) << i END) AS BIGINT) AS low, CAST(sum(CASE WHEN y < 0 OR i < 32 THEN 0 ELSE CAST(1 AS BIGINT) << (i - 32) END) AS BIGINT) AS high, true AS round_trip FROM y GROUP BY vec_id",
    "size_gated_encode": _GATED, "random_zero": _COIN, "fetchsgd_variables": _fetch_variables(),
    # no rotated coordinate is 0 but those of a zero vector, whose scale is 0: the coin decides nothing there
    "sign_coin_roundtrip": f"WITH {_rotated()}, {_SCALE}, {_SIGN_Q}, {_decoded()} {_COMPARE}",
    "packed_kashin": f"WITH {_kashin()} {_COMPARE}", "packed_terngrad": _ternary("2.5 * sp", "a"),
    "report_cells": "SELECT label, round(avg(s), 4) + 0.0 AS mean, round(stddev_samp(s), 4) + 0.0 AS std FROM (SELECT vec_id, label, round(sum(x * x), 6) AS s FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id, label) GROUP BY label",
    "kmeans_objective": _kmeans(3, "identity", " UNION ALL ".join(f"SELECT {k} AS round, (SELECT round(sum(d), 4) + 0.0 FROM (SELECT min(dist) AS d FROM e{k} GROUP BY vec_id)) AS objective" for k in range(3))),
    "power_trace": _power(3, "sign", 0.5, " UNION ALL ".join(f"SELECT {k} AS round, round(any_value(l), 4) + 0.0 AS value, round(sqrt(sum((l * w - u) * (l * w - u))), 4) + 0.0 AS error FROM (SELECT w, u, sum(w * u) OVER () AS l FROM w{k} JOIN u{k} USING (i))" for k in range(3))),
    "training_3_rounds": _training(3, "identity", _WEIGHTS), "training_3_rounds_sign": _training(3, "sign", _WEIGHTS), "training_accuracy": _training(3, "identity", " UNION ALL ".join(_accuracy(k) for k in range(3))),
    "mean_estimate": f"WITH {_rotated(10)}, {_SCALE}, {_SIGN_Q}, {_decoded(10)} SELECT label, CAST(i AS INTEGER) AS i, round(avg(xh), 6) + 0.0 AS mean FROM h GROUP BY label, i",
    "mean_of_ten_clients": f"WITH v0 AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), v AS (SELECT v0.*, CAST(c AS INTEGER) AS client FROM v0, range(10) a(c)), {_SIGNS.format(n=10, d=D)}, r AS (SELECT vec_id, label, client, i, x * s AS x FROM v JOIN sg{D} USING (client, i)), {_transform('y', 'r', 'x', 'vec_id, label, client', D)}, {_SCALE}, {_SIGN_Q}, {_decoded(10)}, e AS (SELECT vec_id, label, i, avg(xh) AS xh FROM h GROUP BY vec_id, label, i), n AS (SELECT e.vec_id, e.label, {_NMSE.format(x='v0.x', h='e.xh')} AS nmse FROM e JOIN v0 ON v0.vec_id = e.vec_id AND v0.i = e.i GROUP BY e.vec_id, e.label) SELECT label, round(avg(nmse), 6) + 0.0 AS mean, round(stddev_samp(nmse), 6) + 0.0 AS std, count(*) AS trials FROM n GROUP BY label",
    "entropy_nmse": _grid(f", z AS (SELECT vec_id, bits, normalisation, {_NMSE.format(x='y', h='(low + span * level / (pow(2.0, bits) - 1))')} AS nmse FROM q GROUP BY vec_id, bits, normalisation) SELECT bits, normalisation, round(avg(nmse), 6) + 0.0 AS nmse FROM z GROUP BY bits, normalisation"),
    "entropy_bits": _grid(f", {_HIST} SELECT bits, normalisation, CAST(sum(n) AS BIGINT) AS n_symbols, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy FROM n GROUP BY bits, normalisation"),
    "count_sketch": f"SELECT row, bucket, round(value, 4) + 0.0 AS value FROM ({_sketch('events', 'user_id', 'value', 5, 97)})",
    "part_sketch": f"SELECT row, bucket, round(value, 4) + 0.0 AS value FROM ({_sketch('lineitem', 'l_partkey', 'l_quantity', 3, 211)})",
    "unsketch_topk": f"WITH s0 AS ({_sketch('events', 'user_id', 'value', 5, 97)}), e AS (SELECT user_id, round(estimate, 4) + 0.0 AS estimate FROM ({_unsketch('s0')})) SELECT * FROM e ORDER BY abs(estimate) DESC, user_id LIMIT 20",
    "fetchsgd": _FETCH,
    "streaming_sketch": f"SELECT w AS window_start, CAST(r AS INTEGER) AS row, {_bucket('r', 'user_id', 31)} AS bucket, round(sum({_sketch_sign('r', 'user_id')} * value), 4) + 0.0 AS value FROM (SELECT date_trunc('day', ts) AS w, * FROM events), range(3) t(r) GROUP BY 1, 2, 3",
    "kmeans_round": _kmeans(1), "kmeans_3_rounds": _kmeans(3), "kmeans_round_sign": _kmeans(1, "sign"), "kmeans_round_two_means": _kmeans(1, "two_means"),
    "power_iteration_2": _power(2, "identity", 1.0), "power_iteration_feedback_2": _power(2, "sign", 0.5),
    "federated_round": _federated("identity", True), "federated_round_unweighted": _federated("identity", False), "federated_round_sign": _federated("sign", True),
    "figure_nmse": _figure(), "codec_report": _report(), "table_nmse": _table(),
    "urr_sign": _uniform_rotation(f"{_SCALE}, {_SIGN_Q}"), "urr_two_means": _uniform_rotation(f"{', '.join(_two_means(3))}, {_two_q('t3', 'y >= t3.cut')}"),
    # what a symbol costs in all is the sum of the merged weights
    "huffman_bits": _grid(f", {_HIST}, h AS (SELECT bits, normalisation, list_sort(list(n)) AS w, CAST(CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END AS BIGINT) AS cost, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY bits, normalisation UNION ALL SELECT bits, normalisation, list_sort(list_append(w[3:], w[1] + w[2])), cost + w[1] + w[2], total FROM h WHERE len(w) > 1) SELECT bits, normalisation, round(cost / total, 6) + 0.0 AS bits_per_coordinate FROM h WHERE len(w) = 1").replace("WITH ", "WITH RECURSIVE ", 1),
    "rolling_metric": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2) SELECT event_type, hour, round(CASE WHEN count(cents) OVER w = 24 THEN avg(cents) OVER w END, 6) + 0.0 AS rolling FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
}

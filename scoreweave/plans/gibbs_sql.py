"""SQL text that repeats the factor sampler draw by draw: the same hashed normals, sums and small triangular solves."""

from __future__ import annotations

ALPHA, INIT_STD = 2.0, 0.05


def _normal(key: str, k: int) -> str:
    """Normal ``k`` of the text that the SQL expression ``key`` gives."""
    uniform = lambda at: f"(('0x' || substr(md5(concat_ws(':', {key}, '{k}')), {at}, 13))::BIGINT::DOUBLE + 0.5) / {2**52}.0"
    return f"sqrt(-2 * ln({uniform(1)})) * cos(2 * pi() * ({uniform(14)}))"


def _drawn(sums: str, dim: int, lot: str) -> str:
    """Vectors from rows (id, a<i><j> precision, b<i> weighted sums): solve by a triangular root, layer by layer."""
    text = sums
    for j in range(dim):
        pivot = f"sqrt(a{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))})"
        below = [f"(a{j}{i}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / {pivot} AS l{i}{j}" for i in range(j + 1, dim)]
        text = f"SELECT *, {', '.join([f'{pivot} AS l{j}{j}', *below])} FROM ({text})"
    for j in range(dim):
        text = f"SELECT *, (b{j}{''.join(f' - l{j}{k} * y{k}' for k in range(j))}) / l{j}{j} AS y{j} FROM ({text})"
    for j in reversed(range(dim)):
        rest = "".join(f" - l{k}{j} * x{k}" for k in range(j + 1, dim))
        text = f"SELECT *, (y{j} + {_normal(f'{lot!r}, id', j)}{rest}) / l{j}{j} AS x{j} FROM ({text})"
    return f"SELECT id, {', '.join(f'x{k}' for k in range(dim))} FROM ({text})"


def _half(name: str, ids: str, key: str, other: str, other_key: str, prior: str | None, dim: int, lot: str) -> list[str]:
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    gram = [f"coalesce(sum(o.x{i} * o.x{j}), 0) AS g{i}{j}" for i, j in pairs]
    pull = [f"coalesce(sum(s.score * o.x{i}), 0) AS p{i}" for i in range(dim)]
    sums = f"""SELECT i.id, {", ".join(gram + pull)} FROM {ids} i LEFT JOIN (obs s JOIN {other} o ON o.id = s.{other_key}) ON s.{key} = i.id GROUP BY i.id"""
    precision = [f"{ALPHA} * g{i}{j}{' + 1' if i == j else ''} AS a{i}{j}" for i, j in pairs]
    weighted = [f"{f'coalesce(m{k}, 0) + ' if prior else ''}{ALPHA} * p{k} AS b{k}" for k in range(dim)]
    joined = f" LEFT JOIN {prior} m ON m.id = q.id" if prior else ""
    rows = f"SELECT q.id, {', '.join(precision + weighted)} FROM {name}_sums q{joined}"
    return [f"{name}_sums AS MATERIALIZED ({sums})", f"{name} AS MATERIALIZED ({_drawn(rows, dim, lot)})"]


def _weights(name: str, vectors: str, features: str, dim: int, lot: str) -> list[str]:
    """Prior means from ``features(id, label, f1, f2)``: a category, or null, and two numbers, 0 where there is none.

    The numbers are solved for first (two equations left when the categories are eliminated), then each category.
    """
    ks = range(dim)
    shaken = f"SELECT f.*, {', '.join(f'v.x{k} + {_normal(f"{lot!r}, {"'noise'"}, f.id", k)} AS e{k}' for k in ks)} FROM {features} f JOIN {vectors} v ON v.id = f.id"
    of_label = f"SELECT label, count(*) + 1.0 AS n, sum(f1) AS c1, sum(f2) AS c2, {', '.join(f'sum(e{k}) + {_normal(f"{lot!r}, {"'feature'"}, any_value(prefix || label)", k)} AS b{k}' for k in ks)} FROM {name}_e WHERE label IS NOT NULL GROUP BY label"
    number = lambda i, k: _normal(f"{lot!r}, 'feature', any_value(name{i})", k)
    numbers = f"SELECT 1 + sum(f1 * f1) AS s11, sum(f1 * f2) AS s12, 1 + sum(f2 * f2) AS s22, {', '.join(f'sum(f{i} * e{k}) + {number(i, k)} AS t{i}{k}' for i in (1, 2) for k in ks)} FROM {name}_e"
    less = f"SELECT any_value(s11) - coalesce(sum(c1 * c1 / n), 0) AS r11, any_value(s12) - coalesce(sum(c1 * c2 / n), 0) AS r12, any_value(s22) - coalesce(sum(c2 * c2 / n), 0) AS r22, {', '.join(f'any_value(t{i}{k}) - coalesce(sum(c{i} * b{k} / n), 0) AS t{i}{k}' for i in (1, 2) for k in ks)} FROM {name}_n LEFT JOIN {name}_l ON true"
    solved = ", ".join(f"(r22 * t1{k} - r12 * t2{k}) / (r11 * r22 - r12 * r12) AS w1{k}, (r11 * t2{k} - r12 * t1{k}) / (r11 * r22 - r12 * r12) AS w2{k}" for k in ks)
    mean = ", ".join(f"f.f1 * w1{k} + f.f2 * w2{k} + coalesce((l.b{k} - l.c1 * w1{k} - l.c2 * w2{k}) / l.n, 0) AS m{k}" for k in ks)
    return [
        f"{name}_e AS MATERIALIZED ({shaken})", f"{name}_l AS MATERIALIZED ({of_label})", f"{name}_n AS MATERIALIZED ({numbers})",
        f"{name}_w AS MATERIALIZED (SELECT {solved} FROM ({less}))",
        f"{name} AS MATERIALIZED (SELECT f.id, {mean} FROM {features} f LEFT JOIN {name}_l l ON l.label = f.label, {name}_w)",
    ]


def sampler(tag: str, dim: int, draws: int, tune: int, seed: int, features: tuple[str, str] | None = None) -> str:
    """CTEs that end in ``{tag}_pd(entity, item, draw, prediction)`` for the cells of ``wanted``.

    ``obs(entity, item, score)``, ``{tag}_u_ids(id)`` and ``{tag}_v_ids(id)`` are defined before; ``features`` names
    the tables of side features of both sides.
    """
    start = ", ".join(f"{INIT_STD} * {_normal(f"'{seed}:-1:v', id", k)} AS x{k}" for k in range(dim))
    parts = [f"{tag}_start AS MATERIALIZED (SELECT id, {start} FROM {tag}_v_ids)"]
    other, priors = f"{tag}_start", {"u": None, "v": None}
    for sweep in range(tune + draws):
        for number, (side, key, other_key) in enumerate((("u", "entity", "item"), ("v", "item", "entity"))):
            name, lot = f"{tag}_{side}{sweep}", f"{seed}:{sweep}:{side}"
            parts += _half(name, f"{tag}_{side}_ids", key, other, other_key, priors[side], dim, lot)
            other = name
            if features and sweep + 1 < tune + draws:
                parts += _weights(f"{name}_m", name, features[number], dim, lot)
                priors[side] = f"{name}_m"
    dot = " + ".join(f"u.x{k} * v.x{k}" for k in range(dim))
    each = [
        f"SELECT c.entity, c.item, {d} AS draw, {dot} AS prediction FROM wanted c JOIN {tag}_u{tune + d} u ON u.id = c.entity JOIN {tag}_v{tune + d} v ON v.id = c.item"
        for d in range(draws)
    ]
    parts.append(f"{tag}_pd AS MATERIALIZED ({' UNION ALL '.join(each)})")
    return ",\n".join(parts)


#: Standardized training scores, as the sampler takes them.
STANDARD = """st AS MATERIALIZED (SELECT item, CASE WHEN count(*) < 3 THEN (SELECT avg(score) FROM train) ELSE avg(score) END AS mu,
    CASE WHEN count(*) < 3 THEN (SELECT stddev_pop(score) FROM train) WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END AS sigma FROM train GROUP BY item),
    obs AS MATERIALIZED (SELECT t.entity, t.item, (t.score - st.mu) / st.sigma AS score FROM train t JOIN st ON st.item = t.item)"""

#: Side features of the stand-in tables: size and organization of entities, two counts and the category of items.
FEATURES = """fu AS MATERIALIZED (SELECT entity AS id, organization AS label, 'organization=' AS prefix, try_cast(regexp_extract(parameters, '([0-9.]+)', 1) AS DOUBLE) / 100 AS f1, 0.0 AS f2,
      'size' AS name1, 'none' AS name2 FROM entities),
    fv AS MATERIALIZED (SELECT item AS id, category AS label, 'category=' AS prefix, num_samples / 50000.0 AS f1, n_subcategories / 50.0 AS f2, 'samples' AS name1, 'subcategories' AS name2 FROM items)"""


def summary(tag: str) -> str:
    """Mean and deviation over the draws of each wanted cell, on the items' own scale."""
    return f"""SELECT p.entity, p.item, avg(prediction) * any_value(sigma) + any_value(mu) AS prediction, stddev_pop(prediction) * any_value(sigma) AS uncertainty
    FROM {tag}_pd p JOIN st ON st.item = p.item GROUP BY p.entity, p.item"""

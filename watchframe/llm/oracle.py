"""SQL twins, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations


def mix_sql(weights: list[tuple[str, int]], seed: int, epochs: int) -> str:
    """The same mix in SQL: one ordered sum per leaf instead of buckets."""
    listed = ", ".join(f"('{path}', {weight})" for path, weight in weights)
    columns = ["l0", "l1", "l2"]
    steps = [f"""w(path, weight) AS (VALUES {listed}),
        d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n, md5(coalesce(text, '')) AS h,
            (('0x' || substr(md5(coalesce(source, '')), 1, 2))::INTEGER % 4)::VARCHAR AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2 FROM documents),
        leaf AS (SELECT l0, l1, l2, sum(n)::BIGINT AS tokens, {epochs} * sum(n)::BIGINT AS capacity FROM d GROUP BY ALL),
        n0 AS (SELECT *, (SELECT least(sum(tokens), sum(capacity)) FROM leaf)::BIGINT AS budget FROM leaf)"""]
    for depth in range(1, 4):
        path, parent, key = columns[:depth], columns[:depth - 1], columns[depth - 1]
        cols, by = ", ".join(path), f"PARTITION BY {', '.join(parent)}" if parent else ""
        joined = " || '/' || ".join(path)
        steps.append(f"""a{depth} AS (SELECT {cols}, sum(capacity)::BIGINT AS capacity, any_value(budget) AS budget FROM n{depth - 1} GROUP BY {cols}),
        b{depth} AS (SELECT a{depth}.*, coalesce(weight, 1)::BIGINT AS weight, capacity / coalesce(weight, 1) AS ratio
            FROM a{depth} LEFT JOIN w ON w.path = {joined}),
        c{depth} AS (SELECT *, budget - coalesce(sum(capacity) OVER p, 0) AS rest,
            sum(weight) OVER ({by}) - coalesce(sum(weight) OVER p, 0) AS heavy
            FROM b{depth} WINDOW p AS ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        e{depth} AS (SELECT *, first_value(CASE WHEN capacity::HUGEINT * heavy > rest * weight THEN rest END IGNORE NULLS) OVER p AS r,
            first_value(CASE WHEN capacity::HUGEINT * heavy > rest * weight THEN heavy END IGNORE NULLS) OVER p AS h
            FROM c{depth} WINDOW p AS ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        n{depth} AS (SELECT n{depth - 1}.* EXCLUDE (budget),
            CASE WHEN r IS NULL THEN e{depth}.capacity ELSE least((r::HUGEINT * weight // h)::BIGINT, e{depth}.capacity) END AS budget
            FROM n{depth - 1} JOIN e{depth} USING ({cols}))""")
    return "WITH " + ",\n        ".join(steps) + f""",
        f AS (SELECT d.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, tokens FROM d JOIN n3 USING (l0, l1, l2)),
        g AS (SELECT *, budget - whole * tokens AS part,
            ('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS pos FROM f),
        h AS (SELECT *, sum(n) OVER (PARTITION BY l0, l1, l2 ORDER BY pos, substr(h, 1, 15), n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM g)
    SELECT doc_id, lang, source, (whole + CASE WHEN part > 0 AND before < part THEN 1 ELSE 0 END)::BIGINT AS copies, n::BIGINT AS mix_tokens,
        budget::BIGINT AS mix_budget FROM h WHERE whole > 0 OR (part > 0 AND before < part)"""

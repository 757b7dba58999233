"""DuckDB SQL of the catalogue, in parts. The simulator's SQL goes day by day, so it shares no algebra with the engine's closed form."""

from __future__ import annotations

from assay.functions.columns import quantile_edges

LOOKBACK, SKIP, VOL, HORIZON, ANN = 52, 4, 13, 4, 52

PARTS = {
    "prices": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS t, CAST(l_suppkey AS VARCHAR) AS asset, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY ALL",
    "cal": "SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM prices)",
    "assets": "SELECT DISTINCT asset FROM prices",
    "grid": "SELECT c.t, c.i, a.asset, p.price FROM cal c CROSS JOIN assets a LEFT JOIN prices p ON p.t = c.t AND p.asset = a.asset",
    "filled": "SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff FROM grid",
    "rets": "SELECT t, i, asset, price, ff / lag(ff) OVER (PARTITION BY asset ORDER BY i) - 1 AS ret FROM filled",
    "vols": f"SELECT t, i, asset, price, ret, CASE WHEN count(ret) OVER w >= {int(VOL * 0.7)} THEN stddev_samp(ret) OVER w * sqrt({ANN}) END AS vol FROM rets WINDOW w AS (PARTITION BY asset ORDER BY i ROWS BETWEEN {VOL - 1} PRECEDING AND CURRENT ROW)",
    "fwds": f"SELECT t, i, asset, lead(price, {HORIZON}) OVER (PARTITION BY asset ORDER BY i) / price - 1 AS fwd FROM grid",
    "scores": "SELECT t, i, asset, CASE WHEN z IS NOT NULL THEN least(greatest(z, -3.0), 3.0) END AS score FROM (SELECT t, i, asset, (raw - avg(raw) OVER (PARTITION BY t)) / nullif(stddev_samp(raw) OVER (PARTITION BY t), 0) AS z "
    f"FROM (SELECT t, i, asset, lag(price, {SKIP}) OVER w / lag(price, {SKIP + LOOKBACK}) OVER w - 1 AS raw FROM grid WINDOW w AS (PARTITION BY asset ORDER BY i)))",
    "reb": "SELECT max(t) AS t FROM cal GROUP BY date_trunc('month', t)",
    "sched": "SELECT row_number() OVER (ORDER BY e.t) - 1 AS period, r.t AS t_signal, e.t AS t_exec, e.i AS i_exec, lead(e.t) OVER (ORDER BY e.t) AS t_next FROM reb r JOIN cal c ON c.t = r.t JOIN cal e ON e.i = c.i + 1",
    "pairs": "SELECT s.t, s.asset, s.score, f.fwd FROM scores s JOIN fwds f ON f.t = s.t AND f.asset = s.asset JOIN reb r ON r.t = s.t WHERE s.score IS NOT NULL AND f.fwd IS NOT NULL",
    # legs of any runs: picks(run_id, t, asset, score, quantile, max_weight, long_short)
    "ranked": "SELECT *, count(*) OVER (PARTITION BY run_id, t) AS cnt, row_number() OVER (PARTITION BY run_id, t ORDER BY score, asset) AS rn FROM picks WHERE score IS NOT NULL",
    "chosen": "SELECT *, greatest(1, CAST(round_even(cnt * quantile, 0) AS BIGINT)) AS n FROM ranked WHERE cnt >= 20",
    "legs": "SELECT run_id, t, asset, max_weight, CASE WHEN rn > cnt - n THEN 1 ELSE -1 END AS side FROM chosen WHERE rn > cnt - n OR (long_short AND rn <= n)",
    "sized": "SELECT *, count(*) OVER (PARTITION BY run_id, t, side) AS n_leg FROM legs",
    "tgt": "SELECT z.run_id, d.i_exec AS i, z.asset, least(1.0 / z.n_leg, z.max_weight) * z.side AS w FROM sized z JOIN sched d ON d.t_signal = z.t",
    "runs": "SELECT DISTINCT run_id FROM picks",
    "book": """
  SELECT r.run_id, CAST(0 AS BIGINT) AS i, a.asset, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS day, CAST(0 AS DOUBLE) AS turn FROM runs r CROSS JOIN assets a
  UNION ALL
  SELECT run_id, i, asset, CASE WHEN ex THEN coalesce(w_new, 0) ELSE w_old END, day, CASE WHEN ex THEN sum(abs(coalesce(w_new, 0) - w_old)) OVER (PARTITION BY run_id) ELSE 0 END
  FROM (SELECT b.run_id, b.i + 1 AS i, b.asset, t.w AS w_new, e.i_exec IS NOT NULL AS ex, sum(b.w * coalesce(g.ret, 0)) OVER (PARTITION BY b.run_id) AS day,
               b.w * (1 + coalesce(g.ret, 0)) / (1 + sum(b.w * coalesce(g.ret, 0)) OVER (PARTITION BY b.run_id)) AS w_old
        FROM book b JOIN rets g ON g.i = b.i + 1 AND g.asset = b.asset LEFT JOIN tgt t ON t.run_id = b.run_id AND t.i = b.i + 1 AND t.asset = b.asset LEFT JOIN sched e ON e.i_exec = b.i + 1)""",
    "everyday": "SELECT run_id, i, max(day) AS gross, max(turn) AS turnover, CAST(count(*) FILTER (abs(w) > 1e-9) AS BIGINT) AS n_positions, sum(abs(w)) AS held FROM book GROUP BY run_id, i",
    "alive": "SELECT run_id, min(i) AS first_live FROM everyday WHERE held > 0 GROUP BY run_id",
    "daily": "SELECT e.run_id, c.t, e.i, e.gross, e.turnover, e.n_positions FROM everyday e JOIN cal c ON c.i = e.i LEFT JOIN alive a ON a.run_id = e.run_id WHERE a.first_live IS NULL OR e.i >= a.first_live",
    "base": "SELECT run_id, t, i, gross - turnover * 5.0 / 1e4 AS ret, turnover, n_positions FROM daily",
}
NEEDS = {
    "prices": [], "cal": ["prices"], "assets": ["prices"], "grid": ["cal", "assets"], "filled": ["grid"], "rets": ["filled"], "vols": ["rets"], "fwds": ["grid"], "scores": ["grid"], "reb": ["cal"], "sched": ["reb"],
    "pairs": ["scores", "fwds", "reb"], "picks": ["scores"], "ranked": ["picks"], "chosen": ["ranked"], "legs": ["chosen"], "sized": ["legs"], "tgt": ["sized", "sched"], "runs": ["picks"], "book": ["runs", "assets", "rets", "tgt", "sched"],
    "everyday": ["book"], "alive": ["everyday"], "daily": ["everyday", "alive", "cal"], "base": ["daily"],
}

#: One run of the scores at the default knobs.
ONE = "SELECT 'base' AS run_id, s.t, s.asset, s.score, 0.1 AS quantile, 0.1 AS max_weight, true AS long_short FROM scores s"
PARTS["picks"] = ONE
SHARPE = f"avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({ANN})"
CAGR = f"CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), {ANN}.0 / count(ret)) - 1 ELSE -1 END"


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def finer(sql: str) -> str:
    """SQL whose numbers are rounded again later: with digits to spare."""
    return sql.replace(", 6) + 0.0", ", 12) + 0.0")


def query(final: str, *parts: str, **own: tuple[list[str], str]) -> str:
    """final, after the named parts and what they need. own: further parts, as (names they need, SQL); a part that is among own is not taken from PARTS."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        needs = own[name][0] if name in own else NEEDS[name]
        for n in needs:
            add(n)
        order.append(name)

    for p in (*own, *parts):
        add(p)
    text = lambda n: own[n][1] if n in own else PARTS[n]
    body = ",\n".join(f"{n}{' AS' if n == 'book' else ' AS MATERIALIZED'} ({text(n)})" for n in order)
    return f"WITH RECURSIVE {body}\n{final}"


def bucket(rank: str, count: str, n_q: int = 10) -> str:
    """The quantile bucket of a rank; see quantile_bucket()."""
    terms = []
    for f in quantile_edges(n_q)[:-1]:
        v = f"({f!r} * ({count} - 1))"
        t = f"({v} - floor({v}))"
        terms.append(f"CASE WHEN {rank} > CASE WHEN {t} >= 0.5 THEN (floor({v}) + 2) - (1 - {t}) ELSE (floor({v}) + 1) + {t} END THEN 1 ELSE 0 END")
    return f"CAST(greatest({' + '.join(terms)}, 1) - 1 AS INTEGER)"


def average_rank(value: str, partition: str) -> str:
    return f"rank() OVER (PARTITION BY {partition} ORDER BY {value}) + (count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0"


def correlation(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"

"""DuckDB SQL of the default model: Newton steps as a recursive query.

Each step sums the gradient and the weighted Gram matrix over the training cards and solves
the linear system by Gauss-Jordan elimination, one nested query per pivot.
"""

from __future__ import annotations

from oracle.extracts import FEATURES, SUMMARY
from oracle.sql import div, rnd
from oracle.tables import compose

NAMES = FEATURES.split(", ")
TERMS = ["1e0", *(f"z{i}" for i in range(1, len(NAMES) + 1))]
SIZE = len(TERMS)
STEPS = 25


def _solved() -> str:
    """The row of sums with the system eliminated: the step for weight r is x{r}."""
    sums = [f"sum((p - y) * {t})" + (f" + b{i}" if i else "") + f" AS a{i}_{SIZE}" for i, t in enumerate(TERMS)]
    for i in range(SIZE):
        for j in range(SIZE):
            sums.append(f"sum(p * (1 - p) * {TERMS[i]} * {TERMS[j]})" + (" + 1e0" if i == j and i else "") + f" AS a{i}_{j}")
    weights = [f"b{i}" for i in range(SIZE)]
    margin = " + ".join(f"b{i} * {t}" for i, t in enumerate(TERMS))
    query = f"""
        SELECT step, {', '.join(weights)}, {', '.join(sums)}
        FROM (SELECT f.*, c.*, 1e0 / (1e0 + exp(-({margin}))) AS p FROM fit f, train c WHERE step < {STEPS})
        GROUP BY step, {', '.join(weights)}"""
    for k in range(SIZE):
        cells = []
        for i in range(SIZE):
            for j in range(k, SIZE + 1):
                own = f"a{k}_{j} / a{k}_{k}"
                cells.append(f"{own} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * ({own}) AS a{i}_{j}")
        query = f"SELECT step, {', '.join(weights)}, {', '.join(cells)} FROM ({query})"
    return query


def default_model() -> dict[str, str]:
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(NAMES, 1))
    z = ", ".join(f"coalesce((x.{c} - t.m{i}) / nullif(t.s{i}, 0), 0) AS z{i}" for i, c in enumerate(NAMES, 1))
    margin = " + ".join(f"b{i} * {t}" for i, t in enumerate(TERMS))
    weights = [f"b{i}" for i in range(SIZE)]
    moved = ", ".join(f"b{i} - a{i}_{SIZE}" for i in range(SIZE))
    fitting = f"""
, fold AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY default_flag ORDER BY md5('42|' || CAST(card_id AS VARCHAR)), card_id)
              > ceil(0.2e0 * count(*) OVER (PARTITION BY default_flag)) AS training
    FROM scores
), ready AS MATERIALIZED (
    SELECT x.card_id, x.training, x.default_flag AS y, {z}
    FROM fold x, (SELECT {moments} FROM fold WHERE training) t
), train AS MATERIALIZED (SELECT * FROM ready WHERE training),
fit(step, {', '.join(weights)}) AS (
    SELECT 0, {', '.join('0e0' for _ in weights)}
    UNION ALL
    SELECT step + 1, {moved} FROM ({_solved()})
), scored AS MATERIALIZED (
    SELECT card_id, y AS label, {margin} AS margin, 1e0 / (1e0 + exp(-({margin}))) AS probability
    FROM ready, (SELECT * FROM fit WHERE step = {STEPS}) WHERE NOT training
), cell AS (
    SELECT l.label, g.prediction, count(s.card_id) AS cards
    FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) g(prediction)
    LEFT JOIN scored s ON s.label = l.label AND (s.probability > 0.5e0)::INT = g.prediction
    GROUP BY ALL
), side AS (
    SELECT c.label, c.cards AS hit, a.support,
           coalesce({div('c.cards', 'b.named')}, 0) AS pr, coalesce({div('c.cards', 'a.support')}, 0) AS re
    FROM cell c
    JOIN (SELECT label, sum(cards) AS support FROM cell GROUP BY ALL) a USING (label)
    JOIN (SELECT prediction, sum(cards) AS named FROM cell GROUP BY ALL) b ON b.prediction = c.label
    WHERE c.label = c.prediction
), line AS (SELECT *, coalesce({div('2 * pr * re', 'pr + re')}, 0) AS f1 FROM side),
ladder AS (
    SELECT round_even(margin * 1e6, 0) AS m, count(*) FILTER (label = 1) AS hits, count(*) FILTER (label = 0) AS others
    FROM scored GROUP BY ALL
), area AS (
    SELECT {rnd(div('sum(won)', '2e0 * sum(hits) * sum(others)'), 8)} AS roc_auc
    FROM (
        SELECT *, hits * (others + 2 * coalesce(sum(others) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS won
        FROM ladder
    )
)
"""

    def query(body: str, *needs: str) -> str:
        sql = compose("@BODY@", "scores", *needs)
        return sql.replace("WITH", "WITH RECURSIVE", 1).replace("@BODY@", fitting + body)

    shown = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {rnd(f'b{i}', 6)} AS weight FROM fit WHERE step = {STEPS}"
        for i, name in enumerate(["intercept", *NAMES])
    )
    total = "(SELECT sum(cards) FROM cell)"
    return {
        "default_model_fit": query(shown),
        "default_model_predict": query(
            f"SELECT card_id, label, (probability > 0.5e0)::INT AS prediction, {rnd('probability', 6)} AS probability FROM scored"
        ),
        "default_model_confusion": query("SELECT label, prediction, cards FROM cell"),
        "default_model_auc": query("SELECT roc_auc FROM area"),
        "default_model_report": query(f"""
            SELECT label::VARCHAR AS class, {rnd('pr', 8)} AS "precision", {rnd('re', 8)} AS recall, {rnd('f1', 8)} AS f1_score,
                   support::BIGINT AS support
            FROM line
            UNION ALL
            SELECT 'accuracy', NULL, NULL, {rnd(div('sum(hit)', total), 8)}, {total}::BIGINT FROM line
            UNION ALL
            SELECT 'macro avg', {rnd('avg(pr)', 8)}, {rnd('avg(re)', 8)}, {rnd('avg(f1)', 8)}, {total}::BIGINT FROM line
            UNION ALL
            SELECT 'weighted avg', {', '.join(rnd(div(f'sum({c} * support)', total), 8) for c in ('pr', 're', 'f1'))}, {total}::BIGINT
            FROM line"""),
        "default_model_roc": query(f"""
            SELECT NULL::DOUBLE AS threshold, 0e0 AS fpr, 0e0 AS tpr
            UNION ALL
            SELECT step / 1e4, {div('sum(alarms) OVER w', 'sum(alarms) OVER ()')}, {div('sum(hits) OVER w', 'sum(hits) OVER ()')}
            FROM (
                SELECT round_even(probability * 1e4, 0) AS step, count(*) FILTER (label = 1) AS hits,
                       count(*) FILTER (label = 0) AS alarms
                FROM scored GROUP BY ALL
            ) WINDOW w AS (ORDER BY step DESC)"""),
        "final_summary": query(f"SELECT c.*, a.roc_auc FROM ({SUMMARY}) c, area a", "latest", "el"),
    }

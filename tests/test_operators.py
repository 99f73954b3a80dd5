"""Operators on hand-written rows."""

from datetime import date

import pytest
from panels import rows, statement

from revolva.config import RiskConfig
from revolva.operators import (
    book,
    charts,
    dashboards,
    default_probability,
    delinquency,
    expected_loss,
    exposure,
    features,
    frames,
    kpis,
    load,
    loss_given_default,
    migration,
    quality,
    vintage,
)


def month(i):
    return date(2022 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def panel(make):
    """Card 1 skips a month, card 2 has one month, card 3 is absent in the last month."""
    return make(
        [
            statement(1, 0, dpd=0),
            statement(1, 2, dpd=30),
            statement(1, 3, dpd=0),
            statement(2, 3, dpd=90, balance=500),
            statement(3, 0, dpd=60),
            statement(3, 1, dpd=90),
        ]
    )


def test_next_observed_month_not_next_calendar_month(panel):
    got = rows(
        features.roll_rate_base(panel).orderBy("card_id", "current_month"),
        "card_id",
        "current_month",
        "next_month",
        "current_bucket",
        "next_bucket",
    )
    assert got == [
        (1, month(0), month(2), "0", "30-59"),
        (1, month(2), month(3), "30-59", "0"),
        (3, month(0), month(1), "60-89", "90+"),
    ]


def test_collections_keep_late_rows_without_a_successor(panel):
    got = rows(book.collections_efficiency(panel), "period_month", "delinquent_accounts", "recovered")
    assert got == [(month(0), 1, 100), (month(1), 1, None), (month(2), 1, 100), (month(3), 1, None)]


def test_vintage_age_is_calendar_based_and_zero_based(panel):
    got = rows(features.vintage_base(panel).orderBy("card_id", "mob"), "card_id", "cohort_month", "mob")
    assert got == [(1, month(0), 0), (1, month(0), 2), (1, month(0), 3), (2, month(3), 0), (3, month(0), 0), (3, month(0), 1)]


def test_statement_number_ignores_gaps(panel):
    got = rows(default_probability.pd_by_age(panel), "mob", "accounts", "defaults")
    assert got == [(1, 3, 1), (2, 2, 1), (3, 1, 0)]


def test_card_absent_in_last_month_has_no_exposure(panel):
    got = {r.card_id: r.ead for r in expected_loss.by_account(panel).collect()}
    assert got == {1: 1750.0, 2: 1625.0, 3: None}
    assert {r.card_id: r.ead for r in frames.expected_loss(panel).collect()} == {1: 1750.0, 2: 1625.0, 3: None}


def test_loss_projection_covers_buckets_of_the_last_month_only(panel):
    got = rows(migration.loss_projection(panel))
    assert got == [("0", 1, 1000, 0.0, 0.0), ("90+", 1, 500, 0.0, 0.0)]


def test_cumulative_default_counts_cards_present_at_the_age(make):
    p = make(
        [
            statement(1, 0),
            statement(1, 1, dpd=90),
            statement(1, 2),
            statement(2, 0),
            statement(2, 2),
        ]
    )
    got = rows(vintage.cumulative(p), "mob", "accounts_at_mob", "cumulative_defaults")
    assert got == [(0, 2, 0), (1, 1, 1), (2, 2, 1)]


def test_early_warning_flags(make):
    p = make(
        [
            statement(1, 0, balance=100, paid=50, dpd=0),
            statement(1, 1, balance=200, paid=40, dpd=30),
            statement(1, 2, balance=300, paid=40, dpd=60),
            statement(1, 3, balance=100, paid=40, dpd=0),
            statement(1, 4, balance=100, paid=40, dpd=10),
            statement(1, 5, balance=100, paid=40, dpd=10),
        ]
    )
    got = [r.ewi_flag for r in features.early_warning(p).orderBy("period_month").collect()]
    assert got == ["TRIPLE WARNING", "DOUBLE WARNING", "CURED", "NEWLY DELINQUENT", "NORMAL"]


def test_streaks_split_on_a_punctual_statement(make):
    late = {1: (0, 1, 1, 1), 2: (1, 1, 0, 1, 1), 3: (1, 1, 1, 0, 1, 1, 1, 1)}
    p = make([statement(c, i, dpd=30 * flag) for c, flags in late.items() for i, flag in enumerate(flags)])
    assert rows(delinquency.delinquency_streaks(p)) == [(3, 4), (1, 3)]
    assert rows(delinquency.delinquency_streaks(p, cfg=RiskConfig(streak_months=2))) == [(3, 4), (1, 3), (2, 2)]


def test_first_payment_default_looks_at_three_statements(make):
    p = make([statement(1, i, dpd=d) for i, d in enumerate((0, 0, 0, 90))] + [statement(2, 0, dpd=60), statement(2, 5, dpd=90)])
    assert rows(delinquency.first_payment_default(p)) == [(2, 90, 2)]


def test_net_roll_counts_stayers_as_arrivals(make):
    p = make(
        [
            statement(1, 0, dpd=30, balance=10),
            statement(1, 1, dpd=45, balance=20),
            statement(1, 2, dpd=0, balance=30),
            statement(2, 1, dpd=30, balance=5),
            statement(2, 2, dpd=0, balance=5),
        ]
    )
    got = rows(migration.net_roll(p))
    assert got == [(month(1), "30-59", 1 - 2, 20 - 25)]


def test_zero_limit_and_zero_balance(make):
    p = make([statement(1, 0, balance=0, paid=0, min_due=0, limit=0), statement(1, 1, balance=0, paid=0, min_due=0, limit=0)])
    (v,) = features.customer_risk_profile(p).collect()
    assert v.avg_utilization is None and v.avg_payment_ratio is None
    # a missing ratio counts as fully used and as fully paid
    assert (v.customer_segment, v.risk_score) == ("Distressed", 40.0)
    (s,) = default_probability.score_12m(p).collect()
    assert s.pd_score_12m is None and s.ifrs9_stage == "Stage 1 (Performing)"
    (u,) = kpis.by_util_band(p).collect()
    assert u.util_band == "Low <40%"
    (f,) = frames.card_features(p).collect()
    assert f.avg_util is None and f.avg_pay_ratio == 0.0
    assert rows(frames.util_bands(p)) == [(None, 2)]
    (d,) = book.risk_decile(p).collect()
    assert d.risk_score is None and d.risk_decile == 1


def test_over_limit_exposure_is_not_floored(make):
    p = make([statement(1, 0, balance=1003, limit=1000)])
    (r,) = exposure.account_ead(p).collect()
    assert (r.unused_limit, r.ead_ccf_75, r.ead_ccf_50) == (-3, 1001.0, 1001.0)
    (q,) = frames.latest_ead(p).collect()
    assert q.ead == 1001.0


def test_exposure_rounding_variants(make):
    # balance 2, limit 4: 2 + 0.75 * 2 = 3.5
    p = make([statement(1, 0, balance=2, limit=4), statement(2, 0, balance=3, limit=5)])
    assert [r.ead for r in frames.latest_ead(p).orderBy("card_id").collect()] == [4.0, 4.0]
    assert [r.ead_ccf_75 for r in exposure.account_ead(p).orderBy("card_id").collect()] == [4.0, 5.0]
    (s,) = exposure.portfolio_ead(p).collect()
    assert s.portfolio_ead_75 == 8.0


def test_stage_counts_of_the_summary_overlap(make):
    quiet = [statement(1, i) for i in range(24)]
    p = make(quiet + [statement(1, 24, dpd=90)], writeoffs=[(1, 1000, 200, date(2023, 1, 1))])
    (r,) = expected_loss.summary(p).collect()
    assert (r.stage_1_accounts, r.stage_3_accounts) == (1, 1)
    assert rows(expected_loss.by_stage(p), "ifrs9_stage", "accounts") == [("Stage 3", 1)]
    assert r.portfolio_lgd == 0.8


def test_joins_inner_and_left(make):
    p = make(
        [statement(1, 0), statement(2, 0), statement(3, 0)],
        cards=[(1, 10, "classic", 2000), (2, 20, "premium", 2000)],
        customers=[(10, "ASIA", "low", 30, 5)],
    )
    assert rows(kpis.by_region(p), "region", "accounts") == [("ASIA", 1)]
    assert rows(kpis.by_product(p).orderBy("product_type"), "product_type", "accounts") == [("classic", 1), ("premium", 1)]
    got = rows(frames.master(p).orderBy("card_id"), "card_id", "customer_id", "product_type", "region")
    assert got == [(1, 10, "classic", "ASIA"), (2, 20, "premium", None), (3, None, None, None)]
    assert rows(frames.pd_by_region(p)) == [("ASIA", 0.0)]


def test_concentration_share_is_of_the_whole_book(make):
    p = make([statement(1, 0, balance=100), statement(9, 0, balance=300)], cards=[(1, 1, "classic", 2000)], customers=[(1, "ASIA", "low", 30, 5)])
    assert rows(book.concentration(p), "customer_id", "total_balance", "pct_of_portfolio") == [(1, 100, 25.0)]


def test_retention_size_is_the_first_months_count(panel):
    got = rows(book.cohort_retention(panel), "cohort_month", "period_month", "initial_size", "active", "retention_pct")
    assert got[0] == (month(0), month(0), 2, 2, 100.0)
    assert (month(0), month(3), 2, 1, 50.0) in got


def test_key_ages_are_null_when_missing(make):
    p = make([statement(1, 0), statement(1, 6, dpd=90), statement(2, 6), statement(2, 0), statement(3, 1)])
    got = rows(vintage.key_ages(p), "cohort_month", "default_rate_mob6", "default_rate_mob12")
    assert got == [(month(0), 50.0, None), (month(1), None, None)]


def test_vintage_loss_needs_a_statement_at_origination(make):
    p = make(
        [statement(1, 0), statement(1, 1, balance=400), statement(2, 3)],
        writeoffs=[(1, 100, 20, date(2023, 5, 5)), (1, 50, 0, date(2023, 6, 5)), (2, 10, 0, date(2023, 6, 5))],
    )
    assert rows(vintage.loss_rate(p)) == [(month(0), 400, 150, 20, 130, 32.5)]


def test_roll_matrix_wide_has_all_rows_and_columns(panel):
    got = frames.roll_matrix_wide(panel)
    assert got.columns == ["dpd_bucket", "0", "1-29", "30-59", "60-89", "90+"]
    assert rows(got)[0] == ("0", 0.0, 0.0, 100.0, 0.0, 0.0)
    assert rows(got)[1] == ("1-29", 0.0, 0.0, 0.0, 0.0, 0.0)
    assert rows(charts.bucket_distribution(panel)) == [("0", 2), ("1-29", 0), ("30-59", 1), ("60-89", 1), ("90+", 2)]


def test_histogram_lists_empty_bins_and_includes_the_top(make):
    p = make([statement(1, 0), statement(2, 0, dpd=90), statement(3, 0, dpd=30)])
    got = charts.pd_histogram(p, bins=4).collect()
    assert [r.bin for r in got] == [0, 1, 2, 3]
    assert sum(r.accounts for r in got) == 3 and got[3].accounts == 1
    one = charts.pd_histogram(make([statement(1, 0)]), bins=4).collect()
    assert [r.accounts for r in one] == [1, 0, 0, 0]


def test_every_third_cohort(make):
    p = make([statement(c, c) for c in range(1, 9)])
    assert [r.cohort_month for r in charts.vintage_sampled(p).collect()] == [month(1), month(4), month(7)]


def test_overview_filters(make):
    p = make(
        [statement(1, 0), statement(1, 1), statement(2, 0, balance=500)],
        customers=[(1, "ASIA", "low", 30, 5), (2, "EUROPE", "high", 30, 5)],
    )
    pick = lambda **f: dashboards.overview_cards(p, **f).first().total_exposure
    assert pick() == 2500
    assert pick(regions=["ASIA"]) == 2000
    assert pick(income_bands=["high"], product_types=["classic"]) == 500
    assert pick(first_month=month(1)) == 1000
    assert pick(regions=["AFRICA"]) is None


def test_loss_shares(make):
    w = [(1, 100, 90, date(2023, 1, 31)), (1, 100, 0, date(2023, 2, 1)), (2, 0, 0, date(2023, 2, 2))]
    p = make([statement(1, 0), statement(2, 0)], writeoffs=w)
    (r,) = loss_given_default.portfolio_lgd(p).collect()
    assert (r.total_writeoffs, r.avg_lgd, r.portfolio_lgd_pct, r.recovery_rate_pct) == (3, 0.55, 55.0, 45.0)
    bands = rows(loss_given_default.lgd_histogram(p), "lgd_band", "writeoffs")
    assert bands == [("0-20% (Low Loss)", 1), ("80-100% (High Loss)", 2)]
    assert rows(loss_given_default.lgd_by_month(p), "writeoff_month", "writeoffs") == [
        (date(2023, 1, 1), 1),
        (date(2023, 2, 1), 2),
    ]


def test_quality_checks_on_dirty_rows(make):
    p = make(
        [
            statement(1, 0),
            statement(1, 0),
            statement(2, 0, balance=-5, dpd=-3, label="0"),
            statement(None, 0, dpd=90, label="0"),
            statement(7, 0, balance=5000, paid=6000),
            statement(7, 1, balance=None, paid=None, dpd=None, limit=None, label="0"),
        ],
        cards=[(1, 1, "classic", 0), (2, None, "classic", None), (2, 5, "classic", 10), (None, 1, "classic", 10)],
        customers=[(1, None, "low", 1, 1), (1, "ASIA", None, 1, 1), (None, "ASIA", "low", 1, 1)],
        writeoffs=[(1, 10, 11, date(2023, 1, 1)), (99, 0, 0, date(2023, 1, 1))],
    )
    one = lambda df: df.first()[-1]
    assert rows(quality.null_customers(p)) == [("customers - null check", 1, 1, 1)]
    assert rows(quality.null_cards(p)) == [("cards - null check", 1, 1, 1)]
    assert rows(quality.null_statements(p)) == [("statements - null check", 1, 1, 1, 1)]
    assert rows(quality.duplicate_customers(p)) == [(1, 2)]
    assert rows(quality.duplicate_cards(p)) == [(2, 2)]
    assert rows(quality.duplicate_statements(p)) == [(1, month(0), 2)]
    counts = dict(rows(quality.issue_counts(p.statements, quality.STATEMENT_ISSUES)))
    assert counts == {
        "negative_balance": 1,
        "negative_dpd": 1,
        "overpayment": 2,
        "over_limit": 1,
        "dpd_bucket_mismatch": 1,
    }
    for name, n in counts.items():
        assert rows(quality.statement_issue(p, name)) == [(name, n)]
    assert one(quality.card_issue(p, "bad_credit_limit")) == 1
    assert one(quality.orphan_cards(p)) == 2
    assert one(quality.orphan_statements(p)) == 3
    assert one(quality.orphan_writeoffs(p)) == 1
    assert one(quality.writeoff_issue(p, "negative_writeoff")) == 1
    assert one(quality.writeoff_issue(p, "recovery_exceeds_writeoff")) == 1
    assert rows(quality.lgd_range(p)) == [(-0.1, -0.1, -0.1)]
    assert dict(rows(load.null_totals(p))) == {"customers": 3, "cards": 3, "statements": 5, "writeoffs": 0}


def test_empty_statements(make, spark):
    p = make([], cards=[(1, 1, "classic", 10)], customers=[(1, "ASIA", "low", 1, 1)])
    assert kpis.portfolio_summary(p).first().total_accounts == 0
    assert rows(migration.roll_matrix(p)) == []
    assert rows(book.rfm_scoring(p)) == []
    assert quality.orphan_statements(p).first()[1] == 0

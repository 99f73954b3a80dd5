import pytest
from pyspark.sql import functions as F

from revolva.operators import book, expected_loss, exposure, kpis, migration, vintage
from revolva.plans import panel
from revolva.sources import mapping, store


@pytest.fixture(scope="module")
def p(spark, medium_dir):
    return store.load(spark, medium_dir)


def test_mapping_counts(p):
    """Sizes of the mapped portfolio at scale factor 0.01."""
    assert p.cards.count() == p.customers.count() == 1500
    assert p.statements.count() == 31634
    assert p.writeoffs.count() == 126
    assert p.statements.where("days_past_due >= 90").count() == 408
    assert p.statements.where("statement_balance = 0").count() == 6149


def test_mapped_panel_is_unique_and_bounded(p):
    assert p.statements.groupBy("card_id", "period_month").count().where("count > 1").count() == 0
    assert p.statements.groupBy("card_id").count().agg(F.max("count")).first()[0] <= mapping.MONTHS


def test_stored_and_lazy_portfolios_agree(spark, p, medium_dir):
    lazy = store.derive(spark, medium_dir)
    for name in ("customers", "cards", "statements", "writeoffs"):
        stored, fresh = getattr(p, name), getattr(lazy, name)
        assert stored.exceptAll(fresh).count() == 0 and fresh.exceptAll(stored).count() == 0
    columns = sorted(p.holders.columns)
    assert p.holders.select(columns).exceptAll(lazy.holders.select(columns)).count() == 0


def test_roll_percentages_add_up(p):
    for r in migration.roll_matrix(p).collect():
        assert sum(v for k, v in r.asDict().items() if k.startswith("pct_")) == pytest.approx(100, abs=0.05)


def test_buckets_partition_the_statements(p):
    assert sum(r.account_months for r in kpis.by_bucket(p).collect()) == p.statements.count()


def test_net_flow_adds_up(p):
    moves = panel.moves(p.statements)
    arrivals = moves.where("next_bucket <> '0'").count()
    cures = moves.where("current_bucket <> '0' and next_bucket = '0'").count()
    assert sum(r.net_account_flow for r in migration.net_roll(p).collect()) == arrivals - cures


def test_scores_are_probabilities_and_stages_cover_all_cards(p):
    account = expected_loss.by_account(p)
    assert account.where("pd < 0 or pd > 1").count() == 0
    assert sum(r.accounts for r in expected_loss.by_stage(p).collect()) == p.statements.select("card_id").distinct().count()


def test_exposure_grows_with_the_factor(p):
    within = exposure.account_ead(p).where("unused_limit >= 0")
    assert within.where("not (current_balance <= ead_ccf_50 and ead_ccf_50 <= ead_ccf_75 and ead_ccf_75 <= ead_ccf_100)").count() == 0
    values = [r.portfolio_ead for r in exposure.ccf_sensitivity(p).collect()]
    assert values == sorted(values)


def test_quintiles_have_equal_size(p):
    sizes = [r["count"] for r in book.rfm_scoring(p).groupBy("freq_quintile").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_retention_never_exceeds_the_cohort(p):
    assert book.cohort_retention(p).where("active > initial_size").count() == 0


def test_curve_totals_match_the_panel(p):
    assert vintage.curves(p).agg(F.sum("accounts")).first()[0] == p.statements.count()


def test_results_do_not_depend_on_partitioning(p):
    from dataclasses import replace

    shuffled = replace(p, statements=p.statements.repartition(13, "period_month"), stored_holders=None)
    for op in (expected_loss.by_account, book.risk_decile, book.rfm_scoring, kpis.by_region, migration.roll_matrix):
        assert op(p).exceptAll(op(shuffled)).count() == 0

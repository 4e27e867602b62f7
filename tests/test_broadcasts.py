"""What queries send through the driver: nothing of a size that follows the input."""

import pytest

from weirflow.plans import fixpoint, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def executed(spark, monkeypatch):
    """The plans of all executions of a query, as they ended, with every settled table that has rows taken for one of many."""
    monkeypatch.setattr(fixpoint, "SHUFFLED_ROWS", 0, raising=False)
    context, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()

    def ended():
        context.listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in (found.apply(i) for i in range(found.size()))}

    def run(name):
        before = ended()
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        return [plan for key, plan in ended().items() if key not in before]

    return run


def broadcasts(plans):
    assert plans
    return [plan for plan in plans if "BroadcastExchange" in plan]


def test_jump_roles(executed):
    assert not broadcasts(executed("g14_jump_roles"))


def test_place_merges(executed):
    assert not broadcasts(executed("g8_place_merges"))


@pytest.mark.parametrize("name", ["g9_merge_operands", "g9_reaching_versions"])
def test_versions(executed, name):
    assert not broadcasts(executed(name))


@pytest.mark.parametrize("name", ["g6_dominance_frontier", "r3_eliminate_dead", "g26_check_graph", "j10_dominates", "t7_propagate_types"])
def test_settled_tables(executed, name):
    assert not broadcasts(executed(name))

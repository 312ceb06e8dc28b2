"""What the physical plans must and must not contain."""

import pytest

from dialogprep.plans.queries import QUERIES
from tests.conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    names = (
        "truncate_tokens", "dialogue_grouped", "collate_batch", "distill_loss_per_batch",
        "missing_image_rejects", "encode_tokens", "embedding_lookup", "role_routing",
        "supervised_token_share", "dense_index",
    )
    return {name: plan_of(QUERIES[name](spark, SF)) for name in names}


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_encoding_turns_shuffles_nothing(plans):
    assert "Exchange" not in plans["encode_tokens"]


def test_filters_and_columns_reach_the_scan(plans):
    plan = plans["role_routing"]
    assert "PushedFilters: [In(role, [assistant,user])]" in plan or "PushedFilters: [In(role" in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan


def test_turns_are_limited_before_their_shuffle(plans):
    plan = plans["truncate_tokens"]
    assert "row_number(), 103, Partial" in plan
    # Text is read once; the other scans are narrow.
    assert plan.count("text:string") == 1


def test_texts_are_shuffled_once_for_whole_dialogues(plans):
    assert plans["dialogue_grouped"].count("text:string") == 1
    assert plans["dialogue_grouped"].count("Exchange hashpartitioning(conv_id#") >= 1

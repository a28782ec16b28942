"""Python workers of a pipeline: one for each task of a stage, remembering one operator's work."""

from millrace.llm import bpe_codec, near_dedup, remembered
from tests.llm.helpers import EDGES, edges


def chained(node, above=False):
    """Whether two Python operators share a stage below the node."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return chained(node.initialPlan(), above)
    python = name == "MapInArrow"
    if python and above:
        return True
    above = (above or python) and "Exchange" not in name
    children = node.children()
    return any(chained(children.apply(k), above) for k in range(children.size()))


def test_no_stage_of_the_encoding_takes_two_workers_a_task(spark, monkeypatch):
    plans, write = [], bpe_codec.stage
    monkeypatch.setattr(bpe_codec, "stage", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan())), write(df, label))[1])
    rows = [*EDGES, *((100 + k, f"{' '.join(f'passage{j % 97}' for j in range(400))} {k}", "en", "a", 0, "k") for k in range(4))]
    whole = bpe_codec.encode_documents(spark.createDataFrame(rows, edges(spark).schema))
    plans.append(("whole", whole._jdf.queryExecution().executedPlan()))
    assert whole.count() == len(rows)
    assert [label for label, plan in plans if chained(plan)] == []


def test_a_worker_remembers_one_operator_at_a_time():
    words = near_dedup._hashes("some words here")
    tool = bpe_codec.codec(bpe_codec.default_tokenizer())
    assert bpe_codec.codec(bpe_codec.default_tokenizer()) is tool and len(remembered._HELD) == 1
    assert (near_dedup._hashes("some words here") == words).all() and list(remembered._HELD) == ["normal words"]
    assert list(near_dedup.link_units(iter([]))) == [] and not remembered._HELD

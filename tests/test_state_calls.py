"""The stream replay's state: calls for groups of entries, not for each; what is kept comes back; labels that many claims share."""

import json
import time

import pytest
from sightline.operators import replay as rp
from sightline.streaming import log as st


class Calls:
    """A map state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.rows.pop(key, None)


def test_entries_share_calls_and_come_back():
    state, want = Calls(), {}
    for batch in range(4):
        kept = st._Kept(state)
        for k in range(batch * 5000, batch * 5000 + 5000):
            kept[f"k{k}"] = want[f"k{k}"] = [k]
        for k in range(batch * 100, batch * 100 + 50):
            del kept[f"k{k}"], want[f"k{k}"]
        kept.flush()
    assert state.calls < 5000
    kept = st._Kept(state)
    assert dict(kept) == want and len(kept) == len(want) and kept.get("k0") is None and "k0" not in kept
    with pytest.raises(KeyError):
        kept["k0"]
    state.calls, kept = 0, st._Kept(state)
    kept["k777"] = [0]
    kept.flush()
    assert state.calls == 3 and max(len(json.loads(v)) for (k,), (v,) in state.rows.items() if k >= 0) < 4 * st.GROUP


def test_claims_of_one_label_take_linear_time():
    took = {}
    for pages in (4000, 32_000):
        graph, began = rp.RunGraph(), time.process_time()
        for k in range(pages):
            graph.apply("c", 2 * k + 1, f"a{k}", "artifact.captured", {"node_id": f"page:{k}", "label": f"https://x.example/{k}"})
            for j, value in enumerate(("crypto", "bonus")):
                graph.apply("c", 2 * k + 2, f"o{k}/{j}", "observation.created", {"observation_id": f"o{k}/{j}", "source_node_id": f"page:{k}", "observation_type": "public_offer_claim", "normalized_value": value})
        took[pages] = time.process_time() - began
        (label,) = [x for x in graph.labels if x.endswith("bonus, crypto")]
        assert len(graph.labels[label]) == pages
    assert took[32_000] < 16 * took[4000] + 0.5, took

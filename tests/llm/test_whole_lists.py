"""Wide lists whose pairs are few beside the postings are compared as they are, without the jobs of a parting."""

import pytest
from test_shared_passages import candidates, components, family, sets_of, similar

from chronoweave.llm import minhash


@pytest.mark.parametrize("heavy, parts", [(1 << 22, False), (1, True)])
def test_lists_are_parted_only_where_pairs_are_many(spark, monkeypatch, heavy, parts):
    written, names = minhash.written, []

    def kept(df, name, **options):
        names.append(name)
        return written(df, name, **options)

    docs = family(120, 4, 0, 1)
    sets = sets_of(docs)
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets, a, b)])
    monkeypatch.setattr(minhash, "written", kept)
    monkeypatch.setattr(minhash, "HEAVY", heavy, raising=False)
    monkeypatch.setattr(minhash, "ENOUGH", 100, raising=False)
    found = candidates(spark, docs, 1)
    assert components(sets, [(a, b) for a, b in found if similar(sets, a, b)]) == want
    assert ("longer" in names) == parts

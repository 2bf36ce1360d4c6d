"""Documents that share many passages meet under each of them: a parting that adds pairs is given up, with the same pairs found."""

from pyspark.sql import functions as F
from test_shared_passages import candidates, components, family, sets_of, similar

from chronoweave.llm import minhash


def test_partings_write_no_more_than_the_lists_have_pairs(spark, monkeypatch):
    written, tables = minhash.written, {}

    def kept(df, name, **options):
        out = written(df, name, **options)
        tables.setdefault(name, []).append((out.count(), minhash.mixed_lists(out).agg(F.sum("cross")).first()[0] if name == "placed" else None))
        return out

    docs = family(70, 12, 4, 7)
    sets = sets_of(docs)
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets, a, b)])
    monkeypatch.setattr(minhash, "written", kept)
    found = candidates(spark, docs, 1)
    assert components(sets, [(a, b) for a, b in found if similar(sets, a, b)]) == want
    ((_, pairs),) = tables["placed"]
    assert 0 < sum(n for n, _ in tables["longer"]) <= pairs

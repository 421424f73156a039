"""Each stage of the pipeline against brute force on its own input, and the whole run against the stages."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
from siltstone.llm import linededup, mixing, quality
from siltstone.session import Scratch, table
from test_operators import SMALL, brute_hits, brute_print, brute_signals


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, scratch = docs.columns, Scratch(spark, "stages")
    bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, SMALL))
        rows, kept = before.collect(), {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns + ["taken"] * (name == "mix_sources")
        if name == "quality_rules":
            model = quality.train(before, table(spark, SMALL, "labels"))
            for r in rows:
                n, _, _, _, again = brute_signals(r.text)
                good = n >= 50 and 100 * again <= 50 * n and model.probability(r.text) >= quality.THRESHOLD
                assert (r.doc_id in kept) == good
        elif name == "line_dedup":
            gone = {(r.doc_id, r.line_no) for r in linededup.line_classes(before).where("NOT kept").collect()}
            assert kept.keys() == {r.doc_id for r in rows} and gone
            for r in rows:
                left = [x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone]
                assert kept[r.doc_id].text == "\n".join(left)
        elif name == "near_duplicates":
            first = {p: p for p in {brute_print(r.text) for r in rows}}
            groups = {p: {p} for p in first}
            for a, b in combinations(first, 2):
                if (a ^ b).bit_count() <= 4 and groups[a] is not groups[b]:
                    both = groups[a] | groups[b]
                    for x in both:
                        groups[x] = both
            least = {}
            for r in sorted(rows, key=lambda r: r.doc_id):
                least.setdefault(id(groups[brute_print(r.text)]), r.doc_id)
            assert kept.keys() == set(least.values())
        elif name == "decontamination":
            assert kept.keys() == {r.doc_id for r in rows if not brute_hits(r.text, bench)[1]}
        else:
            taken = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken > 0}
            assert {k: r.taken for k, r in kept.items()} == taken
    assert Counter(map(repr, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(repr, docs.collect()))

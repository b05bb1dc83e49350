from pitrec.llm import quality_rules

from .helpers import DOCS, frame


def test_common_lines_leave_the_text(spark):
    own = [f"own line {k} with words enough to pass the least count also alone of {k}" for k in range(5)]
    rows = [(k, f"Shared  LINE\there\r\n\n{own[k]}\nshared line here\n", "en", "h", 0) for k in range(4)]
    rows += [(4, f"shared line here\n{own[4]}", "en", "other", 0), (5, None, "en", None, 0)]
    got = {r["id"]: r for r in quality_rules.cleaned(frame(spark, rows, DOCS), least_docs=3, share=0.05).collect()}
    assert [got[k]["text"] for k in range(4)] == [f"\n{own[k]}\n" for k in range(4)]
    assert got[4]["text"] == rows[4][1] and got[5]["text"] == "" and len(got) == 6
    assert [got[k]["n_common_words"] for k in range(6)] == [6, 6, 6, 6, 0, 0] and all(got[k]["kept"] for k in range(5))

import re

import __spark_entry__ as E


def test_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in E.queries()
    assert {"op2_ngram_jaccard", "op4_chat_format", "op6_topk_mtree", "op9_exact_dedup"} <= set(E.oracle_sql())

DATA = "/root/testdata/sf0.001"


def same(a, b):
    """Two pandas tables hold the same rows in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        differ = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not differ.any(), (c, a[differ].head(3), b[differ].head(3))

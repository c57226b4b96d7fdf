"""Plan-shape audits: keyed windows, map-side partial aggregation, pruned scans."""

import contextlib
import io

from conftest import SF001


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_spectrum_windows_are_keyed(spark):
    from specflow.operators.preprocess import first_derivative, normalize_preset
    from specflow.sources import tables as tb
    lg = tb.spectra_long(spark, SF001)
    for df in (first_derivative(lg), normalize_preset(lg, "norm5_SC")):
        p = _plan(df)
        assert "hashpartitioning(pkey" in p
        assert "SinglePartition" not in p


def test_aggregates_combine_map_side_and_scans_are_pruned(spark):
    from specflow.catalog import QUERIES
    p = _plan(QUERIES["metrics_pred_actual"](spark, SF001))
    assert "partial_sum" in p or "partial_count" in p
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_returnflag:string,l_linestatus:string>" in p
    sel = _plan(QUERIES["select_spectra_by_attribute"](spark, SF001))
    assert "EqualTo(label,4)" in sel                       # filter pushed into the scan


def test_array_form_resample_has_no_shuffle_of_spectra(spark):
    """X1 array form: spectra rows are never shuffled or broadcast (only the weights are)."""
    from specflow.operators.preprocess import resample_vec
    from specflow.sources import tables as tb
    ax = tb.axis(spark, SF001)
    new = ax.select("idx", (ax["wave"] + 5.0).alias("wave"))
    p = _plan(resample_vec(tb.spectra_vec(spark, SF001), ax, new))
    # the one-row weight spec is the broadcast (build-right) side; spectra stay in place
    assert "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin Inner BuildRight" in p
    assert "hashpartitioning(pkey" not in p

"""Labels of long sequences."""

from quillgrid.functions.text import alpha_label


def test_panel_letters_past_byte_values(spark):
    """From 4,161 on the first sign used to start anew at code point 0."""
    got = spark.range(1, 8000).select("id", alpha_label("id").alias("a")).collect()
    assert all(r.a == (chr(96 + (r.id - 1) // 26) if r.id > 26 else "") + chr(97 + (r.id - 1) % 26) for r in got)

"""Every known text is found on one line amid other text."""
from vecloom.llm import licences

from .cases import PROSE, documents


def test_each_known_text_on_one_line(spark):
    texts = [*licences.KNOWN, ("Own", "Do as you please with this.")]
    rows = [(i, " ".join(PROSE) + "\n" + t.replace("\n", " ") + "\n\nmore") for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licences.scan(documents(spark, rows), texts=texts).collect()}
    assert got == {i: (None, name) for i, (name, _) in enumerate(texts)}

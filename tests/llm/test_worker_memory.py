"""What workers keep from task to task."""
import weakref

from vecloom.llm import bpe, common


def test_tables_of_other_operators_go():
    ids = bpe.encode_text("Häuser an der Straße, 1234 of them")
    kept = [weakref.ref(bpe.encoder(None)), weakref.ref(bpe.decoder(None))]
    assert bpe.encoder(None) is kept[0]()  # stays until another operator trims
    common.trim()
    assert [k() for k in kept] == [None, None]
    assert bpe.encode_text("Häuser an der Straße, 1234 of them") == ids and bpe.decode_ids(ids) == "Häuser an der Straße, 1234 of them"

"""Ids of texts that normalise to combining marks, and archives that end early or in padding."""

import gzip
import io
import random

import public_tokenizers
import pytest

from corpusloom.llm import subwords, warc

WORD, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path,kind", [(WORD, "lower"), (BYTES, "bytes"), (BYTES, "spaced")])
def test_ids_of_any_letters_and_marks(path, kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = kind == "spaced"
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x21, 0x20000) if chr(c).isalpha()]
    odd = ["হয়,", "কয়.", "क़,", "שׁ.", "İ,", "é.", "é,", "ß!", "ﬁ;"]
    texts = [*odd, *(f"{c}{m} x" for c in rng.sample(letters, 3000) for m in ",."), *("".join(rng.choice([*letters, *" .,!\n"]) for _ in range(20)) for _ in range(500))]
    enc = subwords.UnitEncoder(path, kind)
    ids, ends = enc.encode(texts)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.encode((" " if kind == "spaced" else "") + text, add_special_tokens=False).ids, repr(text)


def archive():
    return [warc.record(i, "http://x/", b"payload %d " % i * 50, "0" * 64) for i in range(3)]


def test_a_cut_archive_is_an_error():
    records = archive()
    whole = gzip.compress(b"".join(records))
    members = b"".join(map(gzip.compress, records))
    for data in (whole, members):
        assert list(warc.records_of(warc.inflated(io.BytesIO(data)))) == records
    for data in (whole[:-1], whole[: len(whole) // 2], members[:-4], members[: len(gzip.compress(records[0])) + 12]):
        with pytest.raises(ValueError):
            list(warc.records_of(warc.inflated(io.BytesIO(data))))
    with pytest.raises(Exception):
        list(warc.inflated(io.BytesIO(whole[:-8] + b"\1" * 8)))


def test_padding_after_members_is_read_over():
    records = archive()
    padded = b"".join(gzip.compress(r) + b"\0" * n for r, n in zip(records, (0, 7, 2_000_000), strict=True))
    assert list(warc.records_of(warc.inflated(io.BytesIO(padded)))) == records
    assert list(warc.inflated(io.BytesIO(b""))) == []

"""Units that are seen again stay in the encoder's cache, however many others pass through it once."""

from velotrace.llm import op4_pieces


def test_units_seen_once_do_not_displace_others():
    enc = op4_pieces.PrefixTable(op4_pieces.model_path(), cache=100)
    lib = op4_pieces.load(op4_pieces.model_path())[1]
    encoded, real = [], enc.unit_ids
    enc.unit_ids = lambda unit: encoded.append(unit) or real(unit)
    often = [f"often{chr(97 + k // 9)}{chr(97 + k % 9)}" for k in range(80)]
    texts = [" ".join(w for w in often for _ in range(2))]
    for turn in range(6):
        texts += [" ".join(f"once{chr(97 + turn)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(240)), " ".join(often)]
    for text in texts:
        ids = lib.encode(text, add_eos=True)
        assert enc.encode(text) == (ids, " ".join(map(str, ids)))
    assert sum("often" in u for u in encoded) == 80 and len(encoded) == 80 + 6 * 240
    assert len(enc.new) <= 100 and len(enc.old) <= 100 and len(enc.once) <= 50 and len(enc.once_old) <= 50

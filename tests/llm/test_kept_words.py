"""Words that outlive the pieces they were found in."""

import public_tokenizers
import pyarrow as pa

from tierspark.llm import bpe_trie


def test_words_are_encoded_once_while_pieces_are_let_go(monkeypatch):
    monkeypatch.setattr(bpe_trie, "MAX_PIECES", 20)
    monkeypatch.setattr(bpe_trie, "MAX_WORDS", 30)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [pa.array([" ".join(f"{chr(97 + n)}{chr(97 + i)}word" for i in range(15))]) for n in range(6)]
    kept, plain = bpe_trie.Encoder(path, True, keep=500), bpe_trie.Encoder(path, True)
    learned = []
    learn = kept._learn_words
    monkeypatch.setattr(kept, "_learn_words", lambda words: (learned.append(len(words)), learn(words)))
    for text in texts * 2:
        assert kept.encode(text)[0].tolist() == plain.encode(text)[0].tolist()
    assert len(kept._numbers) <= 20 + 16 and len(kept._words) <= 500
    assert sum(learned[:6]) > 80 and sum(learned[6:]) == 0

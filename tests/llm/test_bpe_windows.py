"""Operator 8: work that words share is done once."""

import itertools

import public_tokenizers

from revidence.llm import bpe_tree

FILES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_words_of_the_same_pieces_share_their_windows(monkeypatch):
    merged = []
    merge = bpe_tree.Tokenizer.merge
    monkeypatch.setattr(bpe_tree.Tokenizer, "merge", lambda self, data: merged.append(data) or merge(self, data))
    t = bpe_tree.Tokenizer(*FILES)
    pieces = ["quem", "lloz", "thex", "sión", "bber", "eenq", "ofzz", "wron"]
    words = ["".join(p) for p in itertools.product(pieces, repeat=3)]
    for w in words:
        t.encode(w)
    assert len(merged) < len(words), f"{len(merged)} windows merged for {len(words)} words of {len(pieces)} pieces"
    assert len(t.windows) <= bpe_tree.PARTS and len(t.parts) <= bpe_tree.PARTS


def test_frequent_matches_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe_tree, "CACHE", 20_000)
    t = bpe_tree.Tokenizer(*FILES)
    tree, seen = t.tree, []
    t.tree = lambda data: seen.append(data) or tree(data)
    for i in range(1000):
        t.encode(f"quemlloz{'' if i % 2 else 'qz' + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676)}")
        t.encode("thexbber")
    assert seen.count(b"thexbber") == 1 and t.matches.held <= 20_000 and len(t.matches.older) < 200

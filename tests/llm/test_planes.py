import random

import numpy as np
import pyarrow as pa

from tideline.llm import planes, text as T
from tideline.llm.queries import tokenizer_file


def encoded(encoder, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = []
    for block in T.blocks(batch, limit=1 << 12):
        ids, bounds = encoder(block)
        out += [ids[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def test_ids_are_the_tokenizers_own():
    rng = random.Random(5)
    alphabet = "aZb019.,-_'<|>\"()!?/\\~^`{}[]@#$%&*+=:;\x1c\x7f\x00 \t\nßéÉ×÷İıçñÀ́\u0085中 øǅ’ſ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|endoftext|>b", "<|StartOfText|>", "x" * 5000, "7" * 1200, "-" * 3000 + "a", "it's we'll 2024's don't, can't.", "É" * 2000,
              "été, ÉTÉ. ğı, öde"]
    encoder = planes.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == wanted
    assert encoded(encoder, texts) == wanted  # pieces that are known
    small = planes.WordEncoder(tokenizer_file("word_bpe_49k.json"), keep=400)  # cleared again and again
    assert encoded(small, texts) == wanted


def test_plain_words_are_cut_and_learned_once():
    encoder = planes.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    texts = ["alpha Alpha, (ALPHA) alpha-2024 [alpha] alpha/beta été Été!", "beta; 44 (été)"]
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]

    class Whole:
        def __getattr__(self, name):
            def call(texts, **options):
                assert not len(texts), "a plain word passed the whole tokenizer"
                return []
            return call

    encoder.tokenizer = Whole()
    assert encoded(encoder, texts) == wanted
    pieces = {"alpha", "beta", "été", "2", "0", "4", ",", "(", ")", "-", "[", "]", "/", "!", ";"}
    assert encoder.known == len(pieces)
    keys = np.concatenate([own for own, _ in encoder.tables])
    assert len(keys) == len(set(keys.tolist())) == len(pieces)

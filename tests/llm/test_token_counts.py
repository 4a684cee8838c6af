import random

import public_tokenizers
import pytest
from callgrain.llm.token_counts import CHUNK, TokenCounter, count_tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a", "don't we'll 're x'res 'll' 've''s !'s", "a  b", "a \n b\n\n", "\n\n x", " \t ", "tab\tend ",
    "x<|endoftext|> y", "<|endoftext|><|endoftext|>", "12345 67 1a2", "é ñandú 中文 　x", "!!!  ???a", "a" * 500,
    "՘꟎", "the'\0s \0", "I'M we'Re", "a b  c", "'", "' s", "trailing  ", "x'", "x'r", "x'l l",
]


@pytest.fixture(scope="module")
def pair():
    return TokenCounter(PATH), Tokenizer.from_file(PATH)


def library(tok, texts):
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(pair):
    mine, tok = pair
    assert mine.count(HARD).tolist() == library(tok, HARD)


def test_random_texts(pair):
    mine, tok = pair
    rng = random.Random(5)
    letters = "aaeinorst  \n\t'.,!0123éñ中　 lvdm" + "".join(chr(rng.randrange(32, 0x3000)) for _ in range(40))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 5 * CHUNK))) for _ in range(400)]
    assert mine.count(texts).tolist() == library(tok, texts)


def test_long_text_and_columns(spark, pair):
    long = "the quick brown fox's 12 jumps,  over\n" * 20_000
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, long, 9), (3, long, 9)], "doc_id long, text string, n_tokens int")
    rows = sorted(r["n_tokens"] for r in count_tokens(df, PATH).collect())
    n = library(pair[1], [long])[0]
    assert rows == [0, 0, n, n]
    assert count_tokens(df.limit(0), PATH).count() == 0

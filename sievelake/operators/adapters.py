"""Adapters of models to the functions that variants take. Nothing here is imported or loaded before it is called.

Each function returns a callable that loads its model on first use in a worker (see encoders.Lazy) and needs the named
package there: transformers and torch for pair aligners and generators, bert_score for scorers, openai for chats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sievelake.operators.encoders import Lazy, resolve_device


def pair_aligner(model: str, device: str | None = None, most_tokens: int = 128, batch: int = 64, aligned_label: int = 0) -> Callable[[list[str], list[str]], np.ndarray]:
    """Probability that two sentences align, by a sequence-pair classifier: a matrix of original by variant sentences."""

    def load():
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        where = resolve_device(device, torch.cuda.is_available)
        words, net = AutoTokenizer.from_pretrained(model), AutoModelForSequenceClassification.from_pretrained(model).to(where).eval()

        class Held:
            @staticmethod
            def pairs(left: list[str], right: list[str]) -> list[float]:
                out: list[float] = []
                with torch.inference_mode():
                    for at in range(0, len(left), batch):
                        own = words(left[at : at + batch], right[at : at + batch], padding=True, truncation=True, max_length=most_tokens, return_tensors="pt").to(where)
                        out += net(**own).logits.softmax(-1)[:, aligned_label].tolist()
                return out

        return Held

    held = Lazy(f"aligner|{model}", 0, load)

    def align(original: list[str], variant: list[str]) -> np.ndarray:
        left, right = np.repeat(np.array(original, object), len(variant)).tolist(), list(variant) * len(original)
        return np.array(held.pairs(left, right)).reshape(len(original), len(variant))

    return align


def bert_scorer(model: str = "roberta-large", device: str | None = None, batch: int = 64) -> Callable[[list[str], list[str]], list[float]]:
    """F1 of (variant, original) pairs by token embeddings, without inverse document frequencies or rescaling."""

    def load():
        from bert_score import BERTScorer

        return BERTScorer(model_type=model, device=device, batch_size=batch, idf=False, rescale_with_baseline=False)

    held = Lazy(f"scorer|{model}", 0, load)
    return lambda variant, original: held.score(variant, original)[2].tolist()


def token_counter(model: str) -> Callable[[str], int]:
    """Tokens of a text with special ones, uncut."""

    def load():
        from transformers import AutoTokenizer

        return AutoTokenizer.from_pretrained(model)

    held = Lazy(f"tokenizer|{model}", 0, load)
    return lambda text: len(held.encode(text, add_special_tokens=True, truncation=False))


def seq2seq_generator(model: str, tokenizer: str | None = None, device: str | None = None, top_p: float = 0.75, most_new: int = 512, most_tokens: int = 512, seed: int = 42) -> Callable[[str], str]:
    """Sampled output of an encoder-decoder model for one input; seeded for each input, so the order doesn't matter."""

    def load():
        import torch
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

        where = resolve_device(device, torch.cuda.is_available)
        words, net = AutoTokenizer.from_pretrained(tokenizer or model), AutoModelForSeq2SeqLM.from_pretrained(model).to(where).eval()

        class Held:
            @staticmethod
            def write(text: str) -> str:
                torch.manual_seed(seed)
                with torch.inference_mode():
                    own = words(text, return_tensors="pt", truncation=True, max_length=most_tokens).to(where)
                    return words.decode(net.generate(**own, do_sample=True, top_p=top_p, top_k=None, max_new_tokens=most_new)[0], skip_special_tokens=True)

        return Held

    held = Lazy(f"generator|{model}", 0, load)
    return lambda text: held.write(text)


def chat_paraphraser(model: str, instruction: str, temperature: float = 0, seed: int = 42) -> Callable[[str], str]:
    """A chat model's answer to the instruction and the text; the client reads its key from its own environment."""

    def load():
        from openai import OpenAI

        return OpenAI()

    held = Lazy(f"chat|{model}", 0, load)

    def paraphrase(text: str) -> str:
        said = held.chat.completions.create(model=model, temperature=temperature, seed=seed, messages=[{"role": "system", "content": instruction}, {"role": "user", "content": text}])
        return said.choices[0].message.content or ""

    return paraphrase

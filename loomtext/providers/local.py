"""A transformer model from a file, run by onnxruntime, opened once in each worker."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from loomtext.errors import ConfigError, OnnxError, TokenizerError
from loomtext.kernels.pooling import pool, unit
from loomtext.providers.base import Provider

CANDIDATES = ("onnx/model.onnx", "onnx/model_quantized.onnx", "model.onnx")
OUTPUTS = ("sentence_embedding", "last_hidden_state", "pooler_output")
_CLS = ("BAAI/bge-small-en-v1.5", "BAAI/bge-base-en-v1.5", "BAAI/bge-large-en-v1.5", "BAAI/bge-m3", "Snowflake/snowflake-arctic-embed-m", "mixedbread-ai/mxbai-embed-large-v1")
_SEARCH = "Represent this sentence for searching relevant passages: "


def default_pooling(model_id: str) -> str:
    return "cls" if model_id in _CLS else "mean"


def default_prefixes(model_id: str) -> tuple[str, str]:
    """For queries and for documents."""
    if model_id.startswith("BAAI/bge-") and model_id.endswith("-en-v1.5"):
        return _SEARCH, ""
    if "e5-" in model_id:
        return "query: ", "passage: "
    return "", ""


@dataclass
class LocalModel(Provider):
    name: str
    model_path: str
    tokenizer_path: str
    pooling: str | None = None
    query_prefix: str | None = None
    document_prefix: str | None = None
    max_seq_len: int = 512
    intra_threads: int = 1
    _open: Any = field(default=None, init=False, repr=False, compare=False)

    @classmethod
    def from_folder(cls, name: str, folder: str, **settings: Any) -> LocalModel:
        """A model as it is laid out in a repository of models, from a local folder."""
        found = next((p for c in CANDIDATES if os.path.exists(p := os.path.join(folder, c))), None)
        tokenizer = os.path.join(folder, "tokenizer.json")
        if found is None or not os.path.exists(tokenizer):
            raise ConfigError(f"{folder} has no model and tokenizer")
        return cls(name, found, tokenizer, **settings)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def model_id(self) -> str:
        return self.name

    def _session(self):
        if self._open is None:
            import onnxruntime as ort
            from tokenizers import Tokenizer

            options = ort.SessionOptions()
            options.intra_op_num_threads = self.intra_threads
            options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
            try:
                session = ort.InferenceSession(self.model_path, options, providers=["CPUExecutionProvider"])
            except Exception as e:
                raise OnnxError(str(e)) from e
            try:
                tokenizer = Tokenizer.from_file(self.tokenizer_path)
            except Exception as e:
                raise TokenizerError(str(e)) from e
            tokenizer.enable_truncation(self.max_seq_len)
            tokenizer.enable_padding()
            self._open = session, tokenizer
        return self._open

    def dimension(self) -> int:
        shapes = [o.shape for o in self._session()[0].get_outputs()]
        return next((s[-1] for s in shapes if s and isinstance(s[-1], int) and s[-1] > 0), 384)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.embed_document(texts)

    def embed_document(self, texts: list[str]) -> list[list[float]]:
        prefix = default_prefixes(self.name)[1] if self.document_prefix is None else self.document_prefix
        return self._run([prefix + t for t in texts])

    def embed_query(self, texts: list[str]) -> list[list[float]]:
        prefix = default_prefixes(self.name)[0] if self.query_prefix is None else self.query_prefix
        return self._run([prefix + t for t in texts])

    def _run(self, texts: list[str]) -> list[list[float]]:
        session, tokenizer = self._session()
        encoded = tokenizer.encode_batch(texts)
        columns = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        wanted = {i.name for i in session.get_inputs()}
        names = [o.name for o in session.get_outputs()]
        output = next((o for o in OUTPUTS if o in names), names[0])
        try:
            made = session.run([output], {k: np.array(v, np.int64) for k, v in columns.items() if k in wanted})[0]
        except Exception as e:
            raise OnnxError(str(e)) from e
        return states_to_vectors(made, [e.attention_mask for e in encoded], self.pooling or default_pooling(self.name))


def states_to_vectors(made: np.ndarray, masks: list[list[int]], pooling: str) -> list[list[float]]:
    """Rank 2: a vector each, scaled to length 1; rank 3: states to be pooled."""
    made = np.asarray(made, np.float32)
    if made.ndim == 2:
        return [unit(v).tolist() for v in made]
    if made.ndim != 3:
        raise OnnxError(f"an output of rank {made.ndim}")
    return [pool(m.ravel(), made.shape[2], np.array(mask), pooling).tolist() for m, mask in zip(made, masks)]

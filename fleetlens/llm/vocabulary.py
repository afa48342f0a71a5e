"""Pieces of a public SentencePiece model file, as plain values."""

from __future__ import annotations

from dataclasses import dataclass

#: Stands for a space inside pieces.
MARKER = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """``pieces`` are ``(text, id, score)``; ``bytes`` the ids of the 256 byte pieces."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes: tuple[int, ...]

    @property
    def words_apart(self) -> bool:
        """No piece goes on over the start of a word, so words can be taken one by one."""
        return not any(
            p[i + 1] == MARKER and p[i] != MARKER for p, _, _ in self.pieces for i in range(len(p) - 1)
        )


def read_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; of a fixed size, it is shipped with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            raw[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), i, model.get_score(i)))
    if len(raw) != 256:
        raise ValueError("the model has no byte fallback")
    return Vocabulary(tuple(pieces), tuple(raw[b] for b in range(256)))

"""Merge rules of byte-pair vocabularies, asked from the side of finished tokens.

Merging always takes the adjacent pair whose concatenation has the lowest rank,
the leftmost of equals.  Whether two finished tokens may stand side by side
follows from their own merge history alone, so that an encoding can be built
token by token without replaying the merges of the whole text.
"""

from __future__ import annotations

from urlrisk.llm.common import Memo

_NEVER = 1 << 62


class Merges:
    """Histories and adjacency of the tokens of one vocabulary.

    ``ranks`` maps every token (str or bytes) to its merge rank; ``symbols`` are
    the tokens that texts start from, which no merge makes.
    """

    def __init__(self, ranks: dict, symbols: set):
        self.ranks, self.symbols = ranks, symbols
        self.history: dict = {}
        self.fits = Memo(lambda pair: self._side_by_side(*pair, _NEVER))

    def made_from(self, token):
        """The two tokens whose merge makes ``token``; None for a symbol, False if merging never makes it."""
        if token in self.symbols:
            return None
        if token not in self.history:
            rank, self.history[token] = self.ranks[token], False
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if self._reachable(left) and self._reachable(right) and self._side_by_side(left, right, rank):
                    self.history[token] = (left, right)
                    break
        return self.history[token]

    def _reachable(self, token) -> bool:
        return token in self.symbols or token in self.ranks and self.made_from(token) is not False

    def usable(self, token) -> bool:
        """Whether merging the text of the token alone gives the token."""
        return self._reachable(token)

    def _side_by_side(self, left, right, until: int) -> bool:
        """Whether no merge crosses the border of two tokens before the moment ``until``.

        Walks back in time: the younger of the two is taken apart, and the pair
        that stood at the border before must not have merged while it stood.
        """
        while True:
            merged = self.ranks.get(left + right)
            if merged is not None and merged < until:
                return False
            age_left = -1 if left in self.symbols else self.ranks[left]
            age_right = -1 if right in self.symbols else self.ranks[right]
            if age_left > age_right:
                until, left = age_left, self.made_from(left)[1]
            elif age_right >= 0:
                until, right = age_right + 1, self.made_from(right)[0]  # an equal merge further left comes first
            else:
                return True

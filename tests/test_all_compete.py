"""Sentences beyond the most relevant ones compete, too."""

from tenderloom.operators import passages


def greedy(text, query, most):
    every, q, chosen, chars = passages.sentences(text), passages.words(query), [], 0
    w = [passages.words(s) for s in every]
    rank = sorted(range(len(every)), key=lambda i: (-min(1.0, 0.1 + 0.9 * len(q & w[i]) / (len(w[i]) + 1)), i))
    limit = min(most, int(len(text) * passages.MOST_SHARE))
    while len(chosen) < len(rank) and (not chosen or chars < limit):
        value = lambda i: 0.75 * min(1.0, 0.1 + 0.9 * len(q & w[i]) / (len(w[i]) + 1)) - 0.25 * max((passages.likeness(w[i], w[k]) for k in chosen), default=0.0)
        best = max((i for i in rank if i not in chosen), key=value)  # ties: the first by rank
        if chosen and chars + len(every[best]) > limit:
            break
        chosen.append(best)
        chars += len(every[best]) + 1
    return " ".join(every[i] for i in chosen)[:most], len(chosen)


def test_a_sentence_beyond_the_first_fifty_is_chosen():
    """Sixty alike sentences are the most relevant; one that differs from them all is worth more than the second."""
    text = " ".join(["Steel bolts of York are sold."] * 60 + ["Wood for ten boats came over from Norway with steel."])
    found, n = passages.selected(text, "steel", 1200)
    assert found.startswith("Steel bolts of York are sold. Wood for ten boats") and (found, n) == greedy(text, "steel", 1200)
    mixed = " ".join(f"Bolt {i % 9} of lot {i % 23} is {'here' if i % 4 else 'bolt steel'} now." for i in range(300))
    assert passages.selected(mixed, "bolt lot 5 steel", 1200) == greedy(mixed, "bolt lot 5 steel", 1200)

"""What a mix takes from each source, as a plain loop."""

def targets(totals, weights=(5.0, 2.0, 1.0), most=3):
    """The rule in a plain loop."""
    names = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = {}, float(sum(totals.values())), list(names)
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / whole for s in free}
        above = [s for s in free if share[s] > most * totals[s]]
        if not above:
            return target | share
        target |= {s: most * float(totals[s]) for s in above}
        rest -= sum(target[s] for s in above)
        free = [s for s in free if s not in above]
    return target

"""A sequential model of one build, for comparison with the plans."""


def units(messages, protected, atomic):
    """The removable units of a block, front to back, as lists of places."""
    out, at, n = [], 0, len(messages)
    while at < n:
        role, calls, _ = messages[at]
        if role in protected:
            at += 1
            continue
        end = at
        if atomic and role == "assistant" and calls:
            wanted, seen = {c for c in calls if c}, set()
            k = at + 1
            while k < n and messages[k][0] == "tool":
                answer = messages[k][2]
                if answer and (answer not in wanted or answer in seen):
                    break
                if answer:
                    seen.add(answer)
                end = k
                if end - at >= len(calls) and seen == wanted:
                    break
                k += 1
        out.append(list(range(at, end + 1)))
        at = end + 1
    return out


def drop_head(messages, weights, limit, protected=(), atomic=False, least=0):
    total, gone = sum(weights), set()
    if total <= limit:
        return list(range(len(messages)))
    for unit in units(messages, protected, atomic):
        if total <= limit:
            break
        gone.update(unit)
        total -= sum(weights[i] for i in unit)
    kept = [i for i in range(len(messages)) if i not in gone]
    return kept if total <= limit and len(kept) >= max(1, least) else []

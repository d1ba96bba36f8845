"""python -m mnemora.llm.pii_train DOCUMENTS MEMBERS: fit the random field of ``pii`` on a bounded, weakly labelled sample.

The labels come from cue phrases, not from the segments' own form: who is spoken of as a constituent, witness or
writer of a letter is a private person, and so are the other mentions of the same surname in that document; a number
after the words for calling is a phone number, one after those for passports and files an identity number; numbers
after the words for bills, dockets, votes and pages are neither. The last fifth of the sample is held out.
"""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
import regex

from mnemora.llm.pii import LABELS, Model, PublicPeople, Segment, fit, overlaps, segments

#: At most so many documents are used, in the order of their id.
SAMPLE = 6000

# Cue phrases, by the side of the segment on which they stand.
NEITHER = regex.compile(r"(?:docket|Bill|standard|Vote|as in|Drucksache|dossier|expediente|page|Seite|página|division No\.|amendement n°|section|article)\s+$", regex.I)
PHONE = regex.compile(r"(?:rang|Tel\.?:|Tél\.?\s*:|Call|reached on|poster,|répond au|erreichbar|unter|unter der|atiende en el|atiende al|Teléfono:?)\s+$", regex.I)
IDENTITY = regex.compile(r"(?:Passport|insurance no\.|citizen number|personal code:|read out|passeport|le numéro|die Nummer|Der Pass|pasaporte|el número|no\.)\s+$", regex.I)
IDENTITY_AFTER = regex.compile(r"^\s+(?:was printed|in front of|was refused|a été refusé|wurde abgelehnt|fue rechazado)")
PERSON = regex.compile(r"(?:constituent|The witness,|case of|letter from|It was|the nurse|I met|lettre de|Le témoin,|l['’]infirmière|Die Zeugin,|der Pflegerin|Ein Brief von|El testigo,|carta de|la enfermera)\s+$")
PERSON_TITLED = regex.compile(r"(?:I promised|Nobody called|Niemand rief|rappelé|llamó a|prometí a|promis à|versprach es)\s+\S+\s+$")
PERSON_AFTER = regex.compile(r"^\s+(?:deserves better|mérite mieux|verdient mehr|merece)")


def weak_labels(text: str, segs: list[Segment], public: PublicPeople) -> np.ndarray:
    """The labels that the cue phrases give."""
    y = np.zeros(len(segs), int)
    private = set()
    for i, s in enumerate(segs):
        before, after = text[max(0, s.start - 40) : s.start], text[s.end : s.end + 30]
        if s.kind in "ea":
            y[i] = LABELS.index({"e": "email", "a": "address"}[s.kind])
        elif s.kind == "n" and not NEITHER.search(before):
            y[i] = 2 if PHONE.search(before) else 3 if IDENTITY.search(before) or IDENTITY_AFTER.search(after) else 0
        elif s.kind == "p" and not all(public.near(t) == "same" for t in s.tokens) and (PERSON.search(before) or PERSON_TITLED.search(before) or PERSON_AFTER.search(after)):
            private.update(s.tokens)
    for i, s in enumerate(segs):
        if s.kind == "p" and any(t in private for t in s.tokens):
            y[i] = 5
    # of two segments that overlap, the one after a cue is the name, else the longer one
    for i, j in overlaps(segs):
        if y[i] and y[j]:
            y[i if PERSON.search(text[max(0, segs[j].start - 40) : segs[j].start]) else j] = 0
    return y


def main(documents: str, members: str) -> None:
    d = pd.read_parquet(documents).sort_values("doc_id").head(SAMPLE)
    m = pd.read_parquet(members)
    public = PublicPeople(zip(m.given_name, m.surname))
    docs, gold = [], []
    for t in d.text.dropna():
        segs = segments(t, public)
        docs.append(segs)
        gold.append(weak_labels(t, segs, public))
    n = len(docs) * 4 // 5
    # documents without any label teach little: a quarter of them is enough
    kept = [i for i in range(n) if gold[i].any() or i % 4 == 0]
    fitted = fit([docs[i] for i in kept], [gold[i] for i in kept])
    fitted.save()
    model = Model.load()
    told = model.infer(docs[n:])
    for k, name in enumerate(LABELS[1:], 1):
        hit = sum(int(((a == k) & (b == k)).sum()) for a, b in zip(told, gold[n:]))
        print(name, "held out: precision", round(hit / max(1, sum(int((a == k).sum()) for a in told)), 4), "recall", round(hit / max(1, sum(int((b == k).sum()) for b in gold[n:])), 4))
    print("chain", model.chain.round(2).tolist(), "skip", model.skip.round(2).tolist())


if __name__ == "__main__":
    main(*sys.argv[1:3])

"""UEA-Lite's stems."""

import pytest

from textloom.functions import stemmers

# Words and stems.
STANDARD = "man=man happiness=happiness theses=thesis bases=base ordained=ordain killed=kill liked=lik helped=help scarred=scarre invited=invit exited=exit debited=debit running=run settings=set timing=time dying=dy harping=harp charring=char ring=ring sing=se bring=br fling=fle changes=change deaths=death shadows=shadow flies=fly things=thing nothings=nothing witches=witch makes=mak does=do abodes=abod grades=grad wires=wir cares=car USA=USA FLOSS=FLOSS MREs=MRE USAED=USAED ragings=rage was=was 10=10 top-ten=top-ten top_ten=top_ten abcDefGhij=abcDefGhij Tophat=Tophat readings=read insulted=insult cussed=cuss fancies=fancy eroded=erode dog's=dog isn't=isnot they're=theyare dogs'=dogs abcdefghijklmnopqrstuvwxyz=abcdefghijklmnopqrstuvwxyz"
ADAMS = "liked=like scarred=scar invited=invite exited=exit debited=debit smited=smite dying=die ring=ring sing=sing bring=bring fling=fling makes=make smokes=smoke does=do abodes=abode escapades=escapade wires=wire acres=acre MREs=MRE ABCDEFGHIJKLMs=ABCDEFGHIJKLMs ABCDEFGHIJKLM=ABCDEFGHIJKLM menses=menses"


@pytest.mark.parametrize("variant,stems", [("standard", STANDARD), ("adams", ADAMS), ("perl", "ragings=rag")])
def test_uea_lite(variant, stems):
    assert stemmers.uea_lite("", variant) == ""
    for word, stem in (pair.split("=") for pair in stems.split()):
        assert stemmers.uea_lite(word, variant) == stem, word

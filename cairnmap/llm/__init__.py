"""Operators that prepare a training corpus: scans, filters, dedup, classifiers, packing.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames, ignores columns it does not know and keeps these rules:

* Operators that judge a text by itself, or by what the whole corpus says of its values
  (secrets, decontamination, classifiers, packing), treat every row alike, whatever its id.
* For operators that compare documents, ``doc_id`` identifies a document. Rows that
  repeat an id are one document: what is found for the id holds for each of its rows. A
  row whose id is null is not compared; it comes back as if nothing had been found.
* A null text is an empty text. Texts are always processed whole.
"""

"""Reading and writing: corpora, assets, exports."""

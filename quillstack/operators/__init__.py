"""quillstack.operators"""

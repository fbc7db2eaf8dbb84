"""quillstack.sources"""

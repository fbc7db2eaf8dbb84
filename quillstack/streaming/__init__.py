"""quillstack.streaming"""

"""quillstack.plans"""
